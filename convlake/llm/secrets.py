"""Secret scanning with a random forest, in DataFrame functions only.

A text is split at its candidates: assigned values, tokens of known shape, private
key blocks and long strings with digits.  A random forest, trained from labelled
findings, removes the false positives: its features are the candidate's length,
character transitions, dictionary coverage, path shape and neighbouring words.
The trained trees become one SQL expression, so that scanning and masking are a
projection: no shuffle, whatever the number of candidates.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.shared import materialize

#: Labelled findings that the forest is trained from, trees, depth and seed.
FINDINGS, TREES, DEPTH, SEED = 5800, 24, 7, 11
MASK = "[SECRET]"
#: Characters of context before and after a candidate.
BEFORE, AFTER = 48, 24

# Names of secrets, shapes of known tokens.
_NAME = r"key|secret|token|p(?:assw(?:or)?d|assphrase|ass|wd|w)|credentials?|auth|bearer"
_ASSIGN = rf"(?=[akstpcbAKSTPCB])(?i:(?:{_NAME})[\"']?\s{{0,4}}(?::=|=>|=|:)|bearer\s)\s{{0,4}}[\"']?"
# an eyJ soon behind another in one run of characters can only fail as that one did
_KNOWN = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}+|xox[abprs]-[0-9A-Za-z-]{10,}+|[srp]k_(?:live|test)_[0-9A-Za-z]{16,}+|AIza[0-9A-Za-z_-]{35}|(?=eyJ)(?<!(?<![0-9A-Za-z])eyJ[0-9A-Za-z_-]{0,200})eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+"
_LINE = r"[A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
# to the END line, over whatever is no other BEGIN line
_BLOCK = rf"-----BEGIN {_LINE}(?:(?:[^-]++|-(?!----(?:BEGIN|END) {_LINE}))*+-----END {_LINE})?"
_VALUE = r"[^\s\"'`<>,;(){}\[\]|]{8,}+"
# in quotes a value runs to the closing quote, whatever signs are in it
_QUOTED = r"(?<=[\"'])(?=[^\s\"'`]*+[\"'])[^\s\"'`]{8,}+"
_QUOTED_SIGN = r"(?=[^\s\"'`0-9!@#$%^&*]*+[0-9!@#$%^&*])"
# a password in an address
_LOGIN = r"(?<=://[^\s:/@]{0,64}:)[^\s:/@]{4,}+(?=@)"
# a digit or sign anywhere in the value
_SIGN = r"(?=[^\s\"'`<>,;(){}\[\]|0-9!@#$%^&*]*+[0-9!@#$%^&*])"
# where the sign of assignment or a quote leaves no doubt, a value may be letters alone
_LOOSE = rf"(?=[akstpcbAKSTPCB])(?i:(?:{_NAME})[\"']?\s{{0,4}}(?:(?::=|=>|=)\s{{0,4}}[\"']?|:\s{{0,4}}[\"']))"
_BARE = r"(?<![0-9A-Za-z+/_.-])(?=[A-Za-z+/_.-]*+[0-9])[0-9A-Za-z+/_.-]{16,}+={0,2}"
CANDIDATE = rf"{_BLOCK}|(?:{_ASSIGN})(?:{_BLOCK}|{_QUOTED_SIGN}{_QUOTED}|{_SIGN}{_VALUE})|{_LOOSE}(?:{_QUOTED}|{_VALUE})|{_LOGIN}|(?<![0-9A-Za-z])(?:{_KNOWN})|{_BARE}"
#: Strings of which every candidate holds one (or a digit): tried before the expression, which costs more.
HINTS = ("=", ":", "bearer", "-----BEGIN", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "k_live_", "k_test_", "AIza", "eyJ")
LEAD = rf"^(?:{_ASSIGN})(?=[^\s\"'`]{{8}})"
# Words that are common in identifiers and prose.
DICTIONARY = (
    "about account action address after again agent alpha also and api app array article auth back base beta block book branch build button cache call case change char check child class click client clone close cloud code color column comment commit common config connect content control copy count create current custom data date default delete demo detail device dev document domain dummy edit element email enable error event example export fake false field file filter find first folder font form format from function get global group guide handle header height hello help here hidden home host html http icon image import index info input insert install item java key label language last layout length level lib link list load local log login main make manage map master media member menu message meta method mode model module name network new next node not null number object old open option order output package page panel param parent parse pass password path pdf photo placeholder plan please point port post prefix print private process product profile project public query read record redirect release remove render replace report request reset resource response result return role root route sample save schema script search secret section select send server service session set setting shared show sign simple site size sort source span spec start state static status step stop storage store string style submit summary support switch system table tag target task team temp template test text theme the this time title todo token tool total track tree true type update upload url user util valid value var version video view web widget width window with word work write www xxxx year your"
).split()
_SECRET_WORDS = rf"(?i)(?:{_NAME}|key)\W{{0,12}}$"
_OTHER_WORDS = r"(?i)(?:commit|sha-?(?:1|256|512)?|md5|hash|digest|checksum|etag|uuid|guid|revision|integrity|isbn|card|phone|order|invoice|ticket|build|version|example|sample|placeholder)\W{0,12}(?:\w{0,12}\W{0,4})?$"
_FAKE = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|todo|redacted|1234567|abcdef|test"
_PATH = r"^(?:[.~]{0,2}/|[A-Za-z]:|https?:)|/[^/]{1,64}/|\.(?:py|js|ts|c|h|go|rs|java|html?|json|xml|ya?ml|png|jpe?g|gif|css|md|txt|com|org|net|io)\b"


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def features(v: str, before: str, after: str) -> list[str]:
    """SQL of the forest's inputs for a value and the text on both sides."""
    size = f"greatest(length({v}), 1)"
    share = lambda p: f"regexp_count({v}, {literal(p)}) / {size}"
    return [
        f"length({v})",
        f"regexp_count({v}, {literal('[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+')}) / {size}",
        f"1 - length(regexp_replace(lower({v}), {literal('(?:' + '|'.join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ')')}, '')) / {size}",
        f"cast({v} rlike {literal(_PATH)} as int)",
        f"cast({before} rlike {literal(_SECRET_WORDS)} as int)",
        f"cast({before} rlike {literal(_OTHER_WORDS)} as int)",
        f"cast({v} rlike {literal(_FAKE)} as int)",
        share("[0-9]"),
        share("[A-Z]"),
        share("[^0-9A-Za-z]"),
        f"size(array_distinct(split({v}, ''))) / {size}",
        f"cast({v} rlike {literal('^(?:' + _KNOWN + '|-----BEGIN )')} as int)",
        f"cast({before} rlike {literal('[=:]' + chr(92) + 's{0,4}[' + chr(34) + chr(39) + ']?$')} as int)",
        f"cast({after} rlike {literal('^[' + chr(34) + chr(39) + ']')} as int)",
        f"cast({v} rlike {literal('^[A-Za-z]+$')} as int)",
        f"cast({v} rlike {literal('[A-Z]')} as int)",
        f"cast({v} rlike {literal('^[A-Za-z_]+(?:[._:][A-Za-z_]+)+$|^[a-z]+(?:[A-Z][a-z]+)+$')} as int)",
        f"cast({after} rlike {literal('^[(.]')} as int)",
        f"cast({v} rlike {literal('^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$')} as int)",
    ]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(value, before, after, label): labelled findings, made from hashes of their number.

    Two fifths are secrets of twelve kinds; the others are what a scanner mistakes
    for them: digests, uuids, numbers, paths, placeholders, identifiers, versions,
    long words.
    """
    hexa = "concat(sha2(concat('a', id), 256), sha2(concat('b', id), 256))"
    mixed = f"translate(translate(base64(unhex({hexa})), '+/=', 'xYz'), '\r\n', '')"
    number = "lpad(cast(pmod(xxhash64(id), 10000000000000000L) as string), 16, '7')"
    word = lambda k: f"element_at(words, cast(pmod(xxhash64(id, {k}), size(words)) as int) + 1)"
    quote = "substr('\"\\' ', cast(pmod(xxhash64(id, 'q'), 3) as int) + 1, 1)"
    name = "element_at(array('token', 'secret', 'api_key', 'password', 'client_secret', 'access-key', 'TOKEN', 'auth_key'), cast(pmod(xxhash64(id, 'n'), 8) as int) + 1)"
    sign = "element_at(array(' = ', ': ', '=', ':'), cast(pmod(xxhash64(id, 's'), 4) as int) + 1)"
    prose = f"concat({word(1)}, 'ing ', {word(2)}, ' ', {word(3)}, ' ')"
    given = f"concat({prose}, {name}, {sign}, {quote})"
    bare = f"concat({prose}, {word(4)}, ' ')"
    label = "element_at(array('commit ', 'sha256: ', 'md5 = ', 'checksum ', 'uuid ', 'revision ', 'digest: ', 'etag \"'), cast(pmod(xxhash64(id, 'o'), 8) as int) + 1)"
    kinds = [
        (f"substr({hexa}, 1, 40)", given, 1),
        (f"upper(substr({hexa}, 1, 40))", given, 1),
        (f"substr({hexa}, 1, 16 + cast(pmod(id, 5) as int) * 12)", given, 1),
        (f"substr({mixed}, 1, 20 + cast(pmod(id, 40) as int))", given, 1),
        (f"concat('AKIA', upper(substr({hexa}, 1, 16)))", bare, 1),
        (f"concat('ghp_', substr({mixed}, 1, 36))", bare, 1),
        (f"concat({word(5)}, '!', substr({mixed}, 1, 6), cast(pmod(id, 97) as string), '#')", given, 1),
        (f"concat('-----BEGIN PRIVATE KEY-----', {mixed})", bare, 1),
        (f"substr({hexa}, 1, 40)", f"concat({prose}, {label})", 0),
        (f"substr({hexa}, 1, 32)", f"concat({prose}, {label})", 0),
        (f"regexp_replace(substr({hexa}, 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '$1-$2-$3-$4-')", bare, 0),
        (number, bare, 0),
        (number, given, 0),
        (f"concat('src/', {word(6)}, '/', {word(7)}, '_', {word(8)}, cast(pmod(id, 10) as string), '.py')", bare, 0),
        (f"concat('your_', {word(9)}, '_token_', cast(pmod(id, 10) as string))", given, 0),
        (f"concat('example-', {word(10)}, '-key-123')", given, 0),
        (f"concat({word(11)}, {word(12)}, {word(13)}, cast(pmod(id, 100) as string), {word(14)})", bare, 0),
        (f"concat({word(15)}, '.', {word(16)}, '.', {word(17)}, '_', cast(pmod(id, 100) as string))", given, 0),
        (f"concat({word(18)}, '-', {word(19)}, '-1.', cast(pmod(id, 30) as string), '.0-', {word(20)})", bare, 0),
        (f"concat('2024-01-', lpad(cast(pmod(id, 28) + 1 as string), 2, '0'), 'T10:00:', lpad(cast(pmod(id, 60) as string), 2, '0'))", bare, 0),
    ]
    letters = f"translate({mixed}, '0123456789', 'ghijklmnop')"
    ends = lambda k: f"element_at(array('ation', 'ing', 'ness', 'ment', 'ability', 'ized', 'ary'), cast(pmod(xxhash64(id, {k}), 7) as int) + 1)"
    kinds += [
        (f"substr({mixed}, 1, 6 + cast(pmod(id, 20) as int))", f"concat({prose}, 'db://', {word(40)}, ':')", 1),
        (f"concat(substr({mixed}, 1, 5 + cast(pmod(id, 7) as int)), substr(',;(){{}}[]<>|', cast(pmod(id, 11) as int) + 1, 1), substr({mixed}, 20, 4 + cast(pmod(id, 9) as int)))", f"concat({prose}, {name}, {sign}, '\"')", 1),
        (f"concat({word(41)}, '(', {word(42)}, ',', {word(43)}, ')')", f"concat({prose}, {name}, {sign}, '\"')", 0),
        (f"substr({letters}, 1, 18 + cast(pmod(id, 24) as int))", given, 1),
        (f"lower(substr({letters}, 1, 18 + cast(pmod(id, 24) as int)))", given, 1),
        (f"concat({word(22)}, {word(23)}, {word(24)}, {word(25)}, {word(26)})", given, 1),
        (f"concat({word(39)}, cast(pmod(id, 10) as string), substr('!@#$%&', cast(pmod(id, 6) as int) + 1, 1), substr({mixed}, 1, 2 + cast(pmod(id, 5) as int)))", given, 1),
        (f"concat({word(27)}, {ends(28)})", given, 0),
        (f"concat('re', {word(29)}, {ends(30)})", given, 0),
        (f"concat({word(31)}, initcap({word(32)}), initcap({word(33)}))", given, 0),
        (f"concat({word(34)}, '_', {word(35)}, '_', {word(36)})", given, 0),
        (f"concat({word(37)}, '.', {word(38)})", given, 0),
    ]
    after = f"CASE WHEN pmod(xxhash64(id, 'c'), 4) = 0 AND pmod(id, {len(kinds)}) >= {len(kinds) - 3} THEN '(' ELSE {quote} END"
    table = spark.createDataFrame([(DICTIONARY,)], "words array<string>").select("words", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("id"))
    parts = [table.filter(F.pmod("id", F.lit(len(kinds))) == k).selectExpr(f"{v} AS value", f"right({b}, {BEFORE}) AS before", f"concat({after}, ' ', {word(21)}) AS after", f"{y} AS label") for k, (v, b, y) in enumerate(kinds)]
    return materialize(reduce(DataFrame.union, parts).coalesce(2), "findings")


def forest_sql(debug: str, inputs: list[str]) -> str:
    """SQL for the share of trees that vote for class 1, from a forest's printed form."""

    def tree(lines: list[str]) -> str:
        line = lines.pop(0).strip()
        if m := re.fullmatch(r"Predict: ([\d.]+)", line):
            return f"{m[1]}D"
        m = re.fullmatch(r"If \(feature (\d+) <= ([-\d.E]+)\)", line)
        yes = tree(lines)
        lines.pop(0)  # Else
        return f"CASE WHEN {inputs[int(m[1])]} <= {m[2]}D THEN {yes} ELSE {tree(lines)} END"

    trees = [t.splitlines()[1:] for t in re.split(r"\n(?=  Tree \d)", debug)[1:]]
    return "(" + " + ".join(tree([x for x in t if x.strip()]) for t in trees) + f") / {len(trees)}"


def may_match(text: Column) -> Column:
    """Whether a text has a candidate."""
    hint = reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in HINTS if h != "bearer"], text.rlike("[0-9]"))
    return (hint | text.rlike("(?i)bearer")) & text.rlike(CANDIDATE)


class Scanner:
    """A trained scanner; ``threshold`` is the least share of trees that call a candidate a secret."""

    def __init__(self, spark: SparkSession, findings: DataFrame | None = None, threshold: float = 0.5):
        findings = labelled_findings(spark) if findings is None else findings
        names = [f"f{k}" for k in range(len(features("value", "before", "after")))]
        table = findings.selectExpr("cast(label as double) AS label", *(f"cast({x} as double) AS {n}" for n, x in zip(names, features("value", "before", "after"), strict=True)))
        table = VectorAssembler(inputCols=names, outputCol="features").transform(table)
        model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(table)
        self.debug, self.names, self.threshold = model.toDebugString, names, threshold

    def verdicts(self, text: str = "text") -> str:
        """SQL of array<struct<before, match, lead, value, score>>, one for each candidate of a text."""
        re_ = literal(CANDIDATE)
        sides = f"split({text}, {re_}, -1)"
        found = f"transform(arrays_zip(regexp_extract_all({text}, {re_}, 0), slice({sides}, 1, greatest(size({sides}) - 1, 0)), slice({sides}, 2, size({sides}))), x -> struct(x.`1` AS before, x.`0` AS match, regexp_extract(x.`0`, {literal(LEAD)}, 0) AS lead, x.`2` AS after))"
        valued = f"transform({found}, x -> struct(x.before, x.match, x.lead, substr(x.match, length(x.lead) + 1) AS value, right(concat(right(x.before, {BEFORE}), x.lead), {BEFORE}) AS b, left(x.after, {AFTER}) AS a))"
        inputs = ", ".join(f"cast({f} as double) AS {n}" for n, f in zip(self.names, features("x.value", "x.b", "x.a"), strict=True))
        measured = f"transform({valued}, x -> struct(x.before, x.match, x.lead, x.value, struct({inputs}) AS f))"
        return f"transform({measured}, x -> struct(x.before, x.match, x.lead, x.value, {forest_sql(self.debug, [f'x.f.{n}' for n in self.names])} AS score))"

    def find(self, docs: DataFrame) -> DataFrame:
        """doc_id, nth, kind, secret, score of every secret found in ``docs``.

        nth numbers the candidates of a text from 0.  Null and empty texts have
        none.  Rows with null or repeated doc_id are rows like others, repeated
        secrets are findings of their own; no rows: no rows.  Columns other than
        doc_id and text are ignored, whatever their names.
        """
        found = F.when(may_match(F.col("text")), F.expr(self.verdicts()))
        # the outer form: a plain explode would have its array's size tested first, and so the array made twice
        rows = docs.select("doc_id", found.alias("found")).select("doc_id", F.posexplode_outer("found").alias("nth", "x")).filter(F.col("x.score") >= self.threshold)
        kind = F.when(F.col("x.value").startswith("-----BEGIN"), "private_key").when(F.col("x.value").rlike(f"^(?:{_KNOWN})"), "known_token").when(F.col("x.lead") != "", "assigned").otherwise("bare")
        return rows.select("doc_id", "nth", kind.alias("kind"), F.col("x.value").alias("secret"), F.col("x.score").alias("score"))

    def mask(self, docs: DataFrame, mask: str = MASK) -> DataFrame:
        """``docs`` with each secret in ``text`` replaced; every row and column stays, n_chars (if there) is counted anew."""
        # what follows the last candidate is the last part of the split
        masked = f"concat(array_join(transform({self.verdicts()}, x -> concat(x.before, CASE WHEN x.score >= {self.threshold} THEN concat(x.lead, {literal(mask)}) ELSE x.match END)), ''), element_at(split(text, {literal(CANDIDATE)}, -1), -1))"
        out = docs.withColumn("text", F.when(may_match(F.col("text")), F.expr(masked)).otherwise(F.col("text")))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
        return out
