"""License scanning with ordered signature rules, in DataFrame functions only.

A text is reduced to its words (A-Z lower-cased, runs of ASCII letters and digits
and of non-ASCII characters, one blank between two).  This word text is looked at
in pieces that overlap by more than two matches; each rule whose keyword stands in
a piece is tried there at all its places, and a detection belongs to the piece in
whose own part it starts.  One that lies inside the interval of a rule of higher
priority (earlier in the list) is suppressed.

Three base phrases are found everywhere, by consecutive words.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Characters of a piece that are its own.
PIECE = 1024


class Rule(NamedTuple):
    """A regular expression over words and one blank between them; ``weight`` is the score of a detection.

    Each match has ``keyword`` in it, with the blanks around it.
    """

    label: str
    keyword: str
    regex: str
    weight: float


#: Names of licenses in texts (words, as regular expressions) and the versions that each has.
#: "plain" names stand for a license wherever they are (abbreviations); the others are also products, people or
#: ordinary words, and count before "license" only.
FAMILIES = (
    ("apache", "apache", r"apache(?: software)?(?: foundation)?", ("1 0", "1 1", "2 0", "2"), False),
    ("apache", "apache", r"apache", ("2 0",), True),
    ("apache", "asl", r"asl", ("1 1", "2 0"), False),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2 0", "2 1", "3", "3 0"), True),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public", ("2", "2 0", "2 1", "3", "3 0"), False),
    ("lgpl", "library", r"(?:gnu )?library general public", ("2", "2 0", "2 1", "3", "3 0"), False),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1 0", "3", "3 0"), True),
    ("agpl", "affero", r"(?:gnu )?affero general public", ("1 0", "3", "3 0"), False),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "1 0", "2", "2 0", "3", "3 0"), True),
    ("gpl", "general public", r"(?:gnu )?general public", ("1", "1 0", "2", "2 0", "3", "3 0"), False),
    ("mpl", "mozilla", r"mozilla public", ("1 0", "1 1", "2 0"), False),
    ("mpl", "mpl", r"mpl", ("1 0", "1 1", "2 0"), True),
    ("epl", "eclipse", r"eclipse public", ("1 0", "2 0"), False),
    ("epl", "epl", r"epl", ("1 0", "2 0"), False),
    ("cddl", "common development", r"common development and distribution", ("1 0", "1 1"), False),
    ("cddl", "cddl", r"cddl", ("1 0", "1 1"), True),
    ("cpl", "common public", r"common public", ("1 0",), False),
    ("eupl", "european union", r"european union public", ("1 0", "1 1", "1 2"), False),
    ("eupl", "eupl", r"eupl", ("1 0", "1 1", "1 2"), True),
    ("osl", "open software", r"open software", ("1 0", "2 0", "2 1", "3 0"), False),
    ("afl", "academic free", r"academic free", ("1 2", "2 0", "2 1", "3 0"), False),
    ("artistic", "artistic", r"artistic", ("1 0", "2 0"), False),
    ("ofl", "open font", r"(?:sil )?open font", ("1 0", "1 1"), False),
    ("fdl", "free documentation", r"(?:gnu )?free documentation", ("1 1", "1 2", "1 3"), False),
    ("fdl", "gfdl", r"gfdl", ("1 1", "1 2", "1 3"), True),
    ("bsl", "boost", r"boost(?: software)?", ("1 0",), False),
    ("bsl", "bsl", r"bsl", ("1 0",), False),
    ("zpl", "zope", r"zope public", ("1 1", "2 0", "2 1"), False),
    ("php", "php", r"php", ("3 0", "3 01"), False),
    ("psf", "python", r"python(?: software foundation)?", ("2", "2 0"), False),
    ("odbl", "open database", r"open database", ("1 0",), False),
    ("odbl", "odbl", r"odbl", ("1 0",), True),
    ("odc-by", "open data commons", r"open data commons attribution", ("1 0",), False),
    ("busl", "business source", r"business source", ("1 0", "1 1"), False),
    ("sspl", "server side", r"server side public", ("1",), False),
    ("elastic", "elastic", r"elastic", ("1 0", "2 0"), False),
    ("mulan-psl", "mulan", r"mulan permissive software", ("1", "2"), False),
    ("cecill", "cecill", r"cecill(?: free software)?", ("1 0", "2 0", "2 1"), False),
    ("rpl", "reciprocal public", r"reciprocal public", ("1 1", "1 5"), False),
    ("apsl", "apple public", r"apple public source", ("1 0", "1 1", "1 2", "2 0"), False),
    ("lppl", "latex project", r"latex project public", ("1 0", "1 1", "1 2", "1 3"), False),
    ("nasa", "nasa", r"nasa open source", ("1 3",), False),
)
#: Creative Commons kinds, as abbreviated and as written out, and their versions.
CREATIVE = (("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"), ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("cc-by-nc", "by nc", "attribution non ?commercial"), ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s"), ("cc-by-sa", "by sa", "attribution share ?alike"), ("cc-by", "by", "attribution"))
CREATIVE_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Wording of license texts and notices (as in the texts of the public license lists), label, keyword,
#: expression and score; the more telling first.
SIGNATURES = (
    # permissive grants and conditions
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "copies or substantial", r"permission notice shall be included in all copies or substantial portions of the software", 1.0),
    ("mit-0", "mit no attribution", r"mit no attribution", 1.0),
    ("mit-0", "mit 0", r"mit 0 licen[cs]e", 1.0),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("isc", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee", 1.0),
    ("hpnd", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose", 1.0),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software", 1.0),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd licen[cs]e|old bsd licen[cs]e)", 1.0),
    ("bsd-3-clause", "endorse or promote", r"(?:may|must not) be used to endorse or promote products derived from this software", 1.0),
    ("bsd-3-clause", "endorse or promote", r"nor the names of its contributors may be used to endorse or promote products", 1.0),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", 1.0),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd licen[cs]e)", 1.0),
    ("bsd-0-clause", "bsd", r"(?:0bsd|bsd zero clause|zero clause bsd)", 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 0.9),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("ncsa", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", 1.0),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 1.0),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented", 1.0),
    ("bsl", "boost", r"boost software licen[cs]e version 1 0 august 17th 2003", 1.0),
    ("bsl-1.0", "executable object code", r"solely in the form of machine executable object code generated by a source language processor", 1.0),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", "do what the", r"do what the f[a-z ]{1,4} you want to public licen[cs]e", 1.0),
    ("json", "good not evil", r"shall be used for good not evil", 1.0),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 1.0),
    ("ijg", "independent jpeg", r"based in part on the work of the independent jpeg group", 1.0),
    ("openssl", "openssl toolkit", r"developed by the openssl project for use in the openssl toolkit", 1.0),
    ("curl", "name of a copyright holder", r"except as contained in this notice the name of a copyright holder shall not be used in advertising", 1.0),
    ("x11", "x consortium", r"the name of the x consortium shall not be used in advertising", 1.0),
    ("postgresql", "without a written agreement", r"without fee and without a written agreement is hereby granted", 1.0),
    ("w3c", "w3c", r"w3c software notice and licen[cs]e", 1.0),
    ("unicode", "data files", r"unicode inc licen[cs]e agreement data files and software", 1.0),
    ("upl-1.0", "following condition", r"subject to the following condition the above copyright notice and either this complete permission notice", 0.9),
    # copyleft notices
    ("gpl-1.0-or-later", "general public license", r"gnu general public license as published by the free software foundation either version 1", 1.0),
    ("gpl-2.0-or-later", "general public license", r"gnu general public license as published by the free software foundation either version 2", 1.0),
    ("gpl-3.0-or-later", "general public license", r"gnu general public license as published by the free software foundation either version 3", 1.0),
    ("gpl-2.0", "general public license", r"gnu general public license version 2 as published by the free software foundation", 1.0),
    ("gpl-3.0", "general public license", r"gnu general public license version 3 as published by the free software foundation", 1.0),
    ("lgpl-2.0-or-later", "library general public", r"gnu library general public license as published by the free software foundation either version 2", 1.0),
    ("lgpl-2.1-or-later", "lesser general public", r"gnu lesser general public license as published by the free software foundation either version 2 1", 1.0),
    ("lgpl-3.0-or-later", "lesser general public", r"gnu lesser general public license as published by the free software foundation either version 3", 1.0),
    ("agpl-3.0-or-later", "affero general public", r"gnu affero general public license as published by the free software foundation either version 3", 1.0),
    ("gpl", "see the gnu", r"see the gnu general public license for more details", 0.9),
    ("lgpl", "see the gnu", r"see the gnu lesser general public license for more details", 0.9),
    ("agpl", "see the gnu", r"see the gnu affero general public license for more details", 0.9),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public license", 0.9),
    ("lgpl", "received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public license", 0.9),
    ("agpl", "received a copy", r"you should have received a copy of the gnu affero general public license", 0.9),
    ("gpl", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document", 0.8),
    ("gpl-classpath", "classpath exception", r"classpath exception", 0.8),
    ("gpl-font", "font exception", r"font exception", 0.6),
    ("gpl-linking", "linking exception", r"(?:static )?linking exception", 0.7),
    ("mpl-2.0", "mozilla public", r"subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-1.1", "mozilla public", r"contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("epl-2.0", "eclipse public", r"made available under the terms of the eclipse public license 2 0", 1.0),
    ("epl-1.0", "eclipse public", r"made available under the terms of the eclipse public license v1 0", 1.0),
    ("cddl", "common development", r"subject to the terms of the common development and distribution licen[cs]e", 0.9),
    ("fdl", "free documentation", r"copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 1.0),
    ("fdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts", 1.0),
    # apache
    ("apache-2.0", "apache license version 2 0", r"licensed under the apache license version 2 0 the license", 1.0),
    ("apache-2.0", "www apache org", r"www apache org licen[cs]es license 2 0", 1.0),
    ("apache-2.0", "except in compliance", r"you may not use this file except in compliance with the licen[cs]e", 0.9),
    ("apache-2.0", "agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", 1.0),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 0.9),
    # creative commons, public domain, data
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 1.0),
    ("cc0", "creative commons zero", r"creative commons zero", 1.0),
    ("cc0", "waived all copyright", r"waived all copyright and related or neighboring rights", 1.0),
    ("cc", "creativecommons org", r"creativecommons org licen[cs]es", 0.7),
    ("cc-by", "creativecommons org", r"creativecommons org licen[cs]es by [1-4] [05]", 1.0),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licen[cs]es by sa [1-4] [05]", 1.0),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licen[cs]es by nc [1-4] [05]", 1.0),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licen[cs]es by nd [1-4] [05]", 1.0),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licen[cs]es by nc sa [1-4] [05]", 1.0),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licen[cs]es by nc nd [1-4] [05]", 1.0),
    ("public-domain", "public domain", r"(?:has been |is hereby )?(?:placed|released|put|dedicated) (?:in|into|to) the public domain", 1.0),
    ("public-domain", "no copyright", r"no copyright is claimed", 0.8),
    ("public-domain", "copyright to this source", r"disclaims? (?:all )?copyright to this source code", 1.0),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", 0.9),
    ("public-domain", "public domain", r"public domain", 0.6),
    ("ogl-uk", "open government", r"open government licen[cs]e", 0.9),
    ("pddl", "public domain dedication", r"public domain dedication and licen[cs]e", 1.0),
    ("cdla", "community data", r"community data licen[cs]e agreement", 0.9),
    # named licenses
    ("mit", "mit", r"(?:the )?mit(?: style| x11| expat)? licen[cs]ed?", 0.9),
    ("mit", "expat", r"expat licen[cs]e", 0.9),
    ("x11", "x11", r"x11 licen[cs]e", 0.9),
    ("isc", "isc", r"isc licen[cs]e", 0.9),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", 0.8),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", 0.9),
    ("libpng", "libpng", r"libpng licen[cs]e", 0.9),
    ("unlicense", "unlicense", r"(?:the )?unlicense", 0.9),
    ("wtfpl", "wtfpl", r"wtfpl", 1.0),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", 0.9),
    ("ruby", "ruby", r"ruby s? ?licen[cs]e", 0.8),
    ("perl", "perl", r"same terms as perl(?: itself)?", 0.9),
    ("vim", "vim", r"vim licen[cs]e", 0.9),
    ("openssl", "openssl", r"openssl(?: ssleay)? licen[cs]e", 0.9),
    ("curl", "curl", r"curl licen[cs]e", 0.9),
    ("unicode", "unicode", r"unicode(?: data files)?(?: inc)? licen[cs]e", 0.8),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[cs]e", 0.9),
    ("json", "json", r"json licen[cs]e", 0.8),
    ("beerware", "beer", r"beer ?ware licen[cs]e", 0.9),
    ("ijg", "independent jpeg", r"independent jpeg group", 0.8),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", 0.9),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", 0.9),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", 0.9),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", 0.9),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", 1.0),
    ("icu", "icu", r"icu licen[cs]e", 0.8),
    ("ftl", "freetype", r"freetype(?: project)? licen[cs]e", 0.9),
    ("imagemagick", "imagemagick", r"imagemagick licen[cs]e", 0.9),
    ("blueoak", "blue oak", r"blue oak model licen[cs]e", 1.0),
    ("ecl", "educational community", r"educational community licen[cs]e", 0.9),
    ("ipl", "ibm public", r"ibm public licen[cs]e", 0.9),
    ("npl", "netscape public", r"netscape public licen[cs]e", 0.9),
    ("qpl", "q public", r"q public licen[cs]e", 0.9),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", 0.9),
    ("spl", "sun public", r"sun public licen[cs]e", 0.9),
    ("bcl", "binary code", r"binary code licen[cs]e agreement", 0.9),
    ("watcom", "watcom", r"open watcom public licen[cs]e", 0.9),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?", 0.9),
    ("llama", "community license", r"llama(?: [234])?(?: [0-9])? community license agreement", 0.9),
    ("polyform", "polyform", r"polyform (?:noncommercial|shield|strict|internal use|perimeter|small business) licen[cs]e", 1.0),
    ("commons-clause", "commons clause", r"commons clause", 0.9),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e", 0.9),
    ("parity", "parity", r"parity public licen[cs]e", 0.9),
    # restrictions and mere mentions
    ("proprietary", "proprietary", r"proprietary and confidential", 0.9),
    ("proprietary", "proprietary", r"proprietary licen[cs]e", 0.8),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", 1.0),
    ("proprietary", "confidential", r"confidential and proprietary information", 0.8),
    ("no-redistribution", "redistribution", r"redistribution is (?:strictly )?prohibited", 0.9),
    ("no-redistribution", "may not be reproduced", r"may not be reproduced (?:or distributed |or transmitted )?(?:in any form|without)", 0.9),
    ("non-commercial", "non commercial", r"(?:for|personal) non commercial (?:use|purposes) only", 0.8),
    ("non-commercial", "noncommercial", r"for noncommercial (?:use|purposes) only", 0.8),
    ("research-only", "research purposes only", r"for (?:academic and )?research purposes only", 0.8),
    ("evaluation", "evaluation", r"for evaluation purposes only", 0.7),
    ("commercial", "commercial", r"commercial licen[cs]e", 0.6),
    ("eula", "end user", r"end user licen[cs]e agreement", 0.8),
    ("dual", "dual licensed", r"dual licensed under", 0.5),
    ("copyleft", "copyleft", r"copyleft", 0.5),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 0.5),
)
#: Licenses without versions, and their identifiers as words.
IDENTIFIERS = (
    ("mit", "mit(?! 0 )"), ("mit-0", "mit 0"), ("isc", "isc"), ("zlib", "zlib"), ("zlib", "libpng 2 0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("bsd-0-clause", "0bsd"), ("bsd-1-clause", "bsd 1 clause"), ("bsd-2-clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"), ("x11", "x11"), ("ncsa", "ncsa"), ("postgresql", "postgresql"), ("curl", "curl"), ("icu", "icu"), ("hpnd", "hpnd"), ("ftl", "ftl"), ("upl", "upl 1 0"), ("ms-pl", "ms pl"),
    ("ms-rl", "ms rl"), ("blueoak", "blueoak 1 0 0"), ("ecl", "ecl 2 0"), ("ipl", "ipl 1 0"), ("npl", "npl 1 [01]"), ("qpl", "qpl 1 0"), ("sleepycat", "sleepycat"), ("cc0", "cc0 1 0"), ("imagemagick", "imagemagick"),
)
_UNDER = r"(?:licen[cs]ed|released|distributed|available|published|provided|offered|made available) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
_VERSION = r"(?: version| ver| v)? "
#: No further number may follow that would make it another version.
_END = r"(?! [0-9](?: |$))"


def rules() -> list[Rule]:
    """All rules by priority: versions before names, statements of licensing and license texts before mere names."""
    versioned, named = [], []
    for label, keyword, name, versions, plain in FAMILIES:
        before = rf"{name}(?: licen[cs]e)?" if plain else rf"{name} licen[cs]e"
        for v in sorted(versions, key=lambda v: (-len(v), v)):
            # one label for a version, with or without its zero
            full = f"{label}-{v.replace(' ', '.')}" + (".0" if len(v) == 1 else "")
            number = rf"{before}(?: agreement)?{_VERSION}{'?' if plain else ''}v?{v}{_END}"
            versioned.append(Rule(f"{full}-or-later", keyword, rf"(?:{_UNDER})?{number} or (?:at your option )?(?:any )?later(?: version)?", 1.0))
            versioned.append(Rule(full, keyword, rf"{_UNDER}{number}", 1.0))
            versioned.append(Rule(full, keyword, number, 0.9))
            if not plain:
                versioned.append(Rule(full, keyword, rf"{_UNDER}{name}{_VERSION}?v?{v}{_END}", 1.0))
                versioned.append(Rule(full, "spdx", rf"spdx licen[cs]e identifier {name} {v}", 1.0))
        named.append(Rule(label, keyword, rf"{_UNDER}{before}", 0.8))
        named.append(Rule(label, keyword, rf"{name} licen[cs]e", 0.7))
        named.append(Rule(label, "spdx", rf"spdx licen[cs]e identifier {name}(?! ?[0-9])", 1.0))
    creative = []
    for label, short, long in CREATIVE:
        for v in CREATIVE_VERSIONS:
            creative += [Rule(f"{label}-{v.replace(' ', '.')}", k, rf"{p} {v}", 1.0) for k, p in (("cc", f"cc {short}"), ("creative commons", rf"creative commons {long}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"))]
    creative += [Rule(label, k, p, 0.8) for label, short, long in CREATIVE for k, p in (("cc", f"cc {short}"), ("creative commons", f"creative commons {long}"))]
    telling = [Rule(label, "spdx", rf"spdx licen[cs]e identifier {words}", 1.0) for label, words in IDENTIFIERS]
    telling += [Rule(*s) for s in SIGNATURES if s[3] == 1.0]
    return [*versioned, *creative, *telling, *named, *(Rule(*s) for s in SIGNATURES if s[3] < 1.0)]


def reach() -> int:
    """More characters than any match of a rule has, with what it looks at on both sides."""
    return max(_parser.parse(r.regex).getwidth()[1] for r in rules()) + 4


def word_text(text: Column) -> Column:
    """The words of a text, one blank before, between and after them."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), GAP, " ")


#: Words of the rules that are common in any text, and so no gate.
COMMON = frozenset("all and any both based below buy can contents either file for form from have into later made may more name not notice only open other personal placed put received return same see software source subject terms the this under use used versions with without you your".split())


def required(regex: str) -> set[str]:
    """Parts of words (three characters or more) that stand in every match of an expression."""

    def runs(tree: object) -> str:
        out = ""
        for op, arg in tree:
            if str(op) == "LITERAL":
                out += chr(arg)
            elif str(op) == "SUBPATTERN":
                out += f" {runs(arg[-1])} "
            else:
                out += " "
        return out

    return {w for w in runs(_parser.parse(regex)).split() if len(w) > 2}


def gate_words() -> list[str]:
    """A few words of which every match of a rule or base phrase has one (of "cc by", the first)."""
    wanted = []
    for regex, keyword in (*((phrase, phrase) for phrase, _ in BASE), *((r.regex, r.keyword) for r in rules())):
        words = required(regex) | {w for w in keyword.split() if len(w) > 2} or set(keyword.split())
        wanted.append({w for w in words if w not in COMMON} or words)
    out = []
    while wanted:
        count: dict[str, int] = {}
        for words in wanted:
            for w in words:
                count[w] = count.get(w, 0) + 1
        out.append(min(count, key=lambda w: (-count[w], -len(w), w)))
        wanted = [words for words in wanted if out[-1] not in words]
    return [w for w in out if not any(v != w and v in w for v in out if len(v) > 2)]


def may_match(low: Column) -> Column:
    """Whether a lower-cased text has one of the gate words."""
    return reduce(or_, (low.contains(w) if len(w) > 2 else low.contains(w) & low.rlike(f"(?<!{WORD}){w}(?!{WORD})") for w in gate_words()))


def tried(y: str) -> str:
    """SQL of the numbers of the rules that match in a piece; the patterns are literals, so that each is compiled once."""
    by_keyword: dict[str, list[str]] = {}
    for n, r in enumerate(rules()):
        by_keyword.setdefault(f" {r.keyword} " if r.keyword == "cc" else r.keyword, []).append(f"CASE WHEN {y} rlike '{whole(r)}' THEN {n} END")
    groups = (f"CASE WHEN contains({y}, '{k}') THEN array({', '.join(hits)}) END" for k, hits in by_keyword.items())
    return f"array_compact(flatten(array_compact(array({', '.join(groups)}))))"


def whole(rule: Rule) -> str:
    """A rule's expression at word boundaries."""
    return f"(?<= )(?:{rule.regex})(?= )"


def _words(c: Column) -> Column:
    """Number of words in a part of such a text."""
    return (F.length(F.regexp_replace(F.trim(c), "[^ ]", "")) + F.when(F.trim(c) == "", 0).otherwise(1)).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs``.

    n_base counts the places of all base phrases; first_word and last_word are the
    smallest and largest word at which one starts (null if none does).  labels has
    the base labels and those of the rules that are not suppressed; score is the
    largest weight (1 for a base phrase), 0 without labels.  Null texts count as
    empty.  Rows with null or repeated doc_id are rows like others; no rows: no
    rows.  Columns other than doc_id and text are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # lower() folds more than the words do: the gate lets more texts through, never fewer
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.lower("text").alias("low"))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(f"{WORD}++")).cast("long").alias("n_words"), F.when(may_match(F.col("low")), word_text(F.col("text"))).alias("w"))
    # base phrases: what lies between their places
    for k, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"p{k}", F.when(F.col("w").contains(f" {phrase} "), F.split("w", f"(?<= ){phrase}(?= )", -1)))
    size = lambda k: F.coalesce(F.size(f"p{k}") - 1, F.lit(0)).cast("long")
    firsts = [F.when(size(k) > 0, _words(F.element_at(f"p{k}", 1))) for k in range(len(BASE))]
    lasts = [F.when(size(k) > 0, F.col("n_words") - _words(F.element_at(f"p{k}", -1)) - len(BASE[k][0].split())) for k in range(len(BASE))]
    base = F.filter(F.array(*(F.when(size(k) > 0, F.lit(label)) for k, (_, label) in enumerate(BASE))), lambda x: x.isNotNull())
    # a piece is preceded and followed by what a match that touches its own part can reach
    side = reach()
    pieces = F.regexp_extract_all("w", F.lit(rf"(?s)(?=(.{{1,{PIECE + 2 * side}}}))(?:.{{{PIECE}}}|.+)"), F.lit(1))
    rows = rows.select("doc_id", "n_words", sum((size(k) for k in range(len(BASE))), F.lit(0)).cast("long").alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), base.alias("base"), pieces.alias("pieces"))
    # the matches of a rule and what lies between them, then their places
    listed = rules()
    table = F.struct(F.split(F.lit(",".join(r.label for r in listed)), ",").alias("label"), F.split(F.lit("\n".join(whole(r) for r in listed)), "\n").alias("regex"), F.split(F.lit(",".join(str(r.weight) for r in listed)), ",").cast("array<double>").alias("weight"))
    found = f"transform({tried('y')}, n -> struct(n, rules.label[n] AS label, rules.weight[n] AS weight, regexp_extract_all(y, rules.regex[n], 0) AS found, split(y, rules.regex[n], -1) AS parts))"
    hits = f"""transform(coalesce(pieces, array()), y -> flatten(transform({found}, x -> transform(x.found, (m, i) ->
        struct(x.n, x.label, x.weight, length(array_join(slice(x.parts, 1, i + 1), '')) + length(array_join(slice(x.found, 1, i), '')) AS s, length(m) AS size)))))"""
    hits = f"transform({hits}, y -> transform(y, h -> struct(h.n, h.label, h.weight, h.s, h.s + h.size AS e)))"
    own = f"filter(y, a -> (p = 0 or a.s >= {side}) and a.s < {PIECE + side})"
    kept = f"flatten(transform(hits, (y, p) -> filter({own}, a -> not exists(y, b -> b.n < a.n and b.s <= a.s and b.e >= a.e))))"
    rows = rows.withColumn("rules", table).withColumn("hits", F.expr(hits)).withColumn("kept", F.expr(kept))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("kept", lambda x: x["label"]))))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("kept", lambda x: x["weight"])), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
