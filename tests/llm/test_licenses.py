import random
import re
from re import _parser

from convlake.llm import licenses


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [None, "", "...", "CC BY", "cc-by cc by, CC\nBY", "acc by", "cc byte", "GNU General Public License, version 3.", "All rights reserved. all RIGHTS reserved", "all rights reserved", "general  public--license general public", "Kc Kcc by", "İcc by cc by", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Copyright 2020 Someone. All rights reserved", "word " * 30000 + "all rights reserved" + " word" * 30000, "cc by " * 500, "public domain", "x" * 50000]


def test_base_columns_match_brute_force(spark):
    r = random.Random(2)
    bits = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "é", "x1", "-", "."]
    texts = TEXTS + [r.choice([" ", "  ", "-", "\n"]).join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(300)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "cc by", "x"), (3, "CC BY", "x")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, rules string")).collect()
    assert sorted(repr(tuple(g)[:6]) for g in got) == sorted(repr((i, *brute(t))) for i, t, _ in rows)
    for g in got:
        labels = g["labels"].split(",") if g["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, g["base_labels"].split(","))) <= set(labels)
        assert 0 <= g["score"] <= 1 and (g["score"] > 0) == bool(labels)


def test_rules_and_suppression(spark):
    want = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Released under the MIT License.": "mit",
        "GNU Lesser General Public License version 2.1 or any later version": "gpl,lgpl-2.1-or-later",
        "All rights reserved. It runs with Python 2 and PHP 3.0": "reserved",
        "the public interest grew as elastic 2 0 bands licensed": "",
        "boost 1.0 and artistic 2.0, licensed": "",
        "PHP License, version 3.01": "php-3.01",
        "SPDX-License-Identifier: Python-2.0": "psf-2.0",
        "under the GPLv2 or the LGPL v2.1": "gpl-2.0,lgpl-2.1",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "Redistribution and use in source and binary forms, with or without modification": "bsd",
        "dedicated to the public domain": "public-domain",
        "nothing here": "",
    }
    rows = list(enumerate(want))
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == want
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert len(licenses.rules()) > 300


RULES = [(r, re.compile(f"(?<= )(?:{r.regex})(?= )")) for r in licenses.rules()]


def brute_rules(text):
    """Labels and score by all rules over the whole word text."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", f" {low} ")
    hits = [(n, r.label, r.weight, *m.span()) for n, (r, p) in enumerate(RULES) for m in p.finditer(w)]
    kept = [a for a in hits if not any(b[0] < a[0] and b[3] <= a[3] and b[4] >= a[4] for b in hits)]
    base = [label for phrase, label in licenses.BASE if f" {phrase} " in w]
    return ",".join(sorted({*base, *(a[1] for a in kept)})), max([1.0 for _ in base] + [a[2] for a in kept], default=0.0)


def assert_rules(spark, texts):
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(t[-200:], got[i]) for i, t in enumerate(texts)] == [(t[-200:], brute_rules(t)) for t in texts]


def test_signatures_at_all_distances_behind_a_keyword(spark):
    signs = ["released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy", "Apache License, Version 2.0 or later", "Redistribution and use in source and binary forms, with or without modification", "creative commons attribution share alike 4.0", "dedicated to the public domain"]
    assert_rules(spark, [f"copyright holder {'word ' * k}{s}" for s in signs for k in range(81)])


def test_all_places_of_a_rule_and_edges_of_pieces(spark):
    once = "licensed under the gnu gpl version 2"
    texts = [f"{once} and then gpl 2", f"gpl license. {once}", f"cc by nc 4.0 {'x ' * 900} cc by nc", "cc by nc 4.0, " * 400]
    step = licenses.PIECE
    texts += ["license " + "é" * (step * k + d) + f" {once} or any later version, public domain" for k in (1, 2) for d in range(-260, 260, 7)]
    r = random.Random(5)
    bits = "license licensed under the terms of gnu gpl lgpl lesser general public version v 2 1 0 3 or any later mit apache software cc by nc sa creative commons attribution in to domain dedicated 4 word é".split()
    texts += [" ".join(r.choice(bits) for _ in range(r.randint(200, 1500))) for _ in range(40)]
    assert_rules(spark, texts)


def samples(tree, pick):
    """A text that a parsed expression matches; ``pick`` chooses a branch or a number of repeats."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, x = arg[0]
            out += chr(x if str(kind) == "LITERAL" else x[0])
        elif name == "BRANCH":
            out += samples(pick(arg[1]), pick)
        elif name == "SUBPATTERN":
            out += samples(arg[-1], pick)
        elif name == "MAX_REPEAT":
            out += "".join(samples(arg[2], pick) for _ in range(pick(range(arg[0], arg[1] + 1))))
        else:
            assert name == "ASSERT_NOT"
    return out


def test_each_rule_alone_in_a_text(spark):
    r = random.Random(7)
    texts = ["BSD 3-Clause", "Apache 2.0", "MPL 2.0", "under the same terms as Perl itself", "The Software shall be used for Good, not Evil", "ASL license 2.0", "GNU Library General Public License"]
    for rule in licenses.rules():
        made = {samples(_parser.parse(rule.regex), pick) for pick in (lambda x: x[0], lambda x: x[-1], r.choice, r.choice)}
        assert all(re.fullmatch(rule.regex, t) and rule.keyword in t for t in made)
        texts += sorted(made)
    assert all(brute_rules(t)[0] for t in texts)
    assert_rules(spark, texts)


def test_identifiers_and_abbreviations_with_other_meanings(spark):
    cases = {
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: MIT-0": "mit-0", "// SPDX-License-Identifier: ISC": "isc", "SPDX-License-Identifier: Zlib": "zlib", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "SPDX-License-Identifier: BSL-1.0": "bsl-1.0", "SPDX-License-Identifier: 0BSD": "bsd-0-clause",
        "the student learned ASL 2.0 today": "", "she speaks BSL 1.0 well": "", "licensed under ASL 2.0": "apache-2.0", "the ASL license 2.0": "apache-2.0",
        "GNU GPLv3": "gpl-3.0", "gpl 3.0": "gpl-3.0", "GPL 3": "gpl-3.0", "GPL version 2 or later": "gpl-2.0-or-later",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases
