import random
import re

import pytest

from convlake.operators import chunks

END = re.compile(r"(?<=[.!?])\s+")


def slices(text, most):
    out, at = [], 0
    while at < len(text):
        end = min(at + most, len(text))
        space = text.rfind(" ", at, end) if end < len(text) else -1
        end = space if space > at else end
        out.append(text[at:end].strip())
        at = end
        while text[at : at + 1] == " ":
            at += 1
    return [p for p in out if p]


def sentences(text, most, target):
    out, have = [], ""
    for s in filter(None, map(str.strip, END.split(text.strip()))):
        if have and (len(s) > most or len(have) + 1 + len(s) > most):
            out.append(have)
            have = ""
        if len(s) > most:
            out += slices(s, most)
            continue
        have = f"{have} {s}" if have else s
        if len(have) >= target:
            out.append(have)
            have = ""
    return [*out, have] if have else out


def brute(text, most=1600, target=1000, first=400):
    lines, at, found, fence, paragraph = (text or "").split("\n"), 0, [], None, None
    for i, line in enumerate([*lines, ""]):
        over = i == len(lines)
        if fence is not None:
            fence[1].append(line)
            if over or line.startswith("```"):
                found.append(("code", "\n".join(fence[1][: -1 if over else None]).rstrip("\n"), fence[0]))
                fence = None
        elif line.strip() and not line.startswith("```") and not line.lstrip().startswith("#"):
            paragraph = paragraph or (at, [])
            paragraph[1].append(line)
        else:
            if paragraph:
                found.append(("paragraph", "\n".join(paragraph[1]).rstrip(), paragraph[0]))
                paragraph = None
            if line.startswith("```"):
                fence = (at, [line])
            elif line.strip():
                found.append(("heading", line.rstrip(), at))
        at += len(line) + 1
    out = []
    for kind, body, start in found:
        parts = [body] if len(body) <= most else sentences(body, most, target) if kind == "paragraph" else slices(body, most)
        for p in parts:
            out.append(("sentence_group" if len(body) > most and kind == "paragraph" else kind, p, start))
            start += len(p) + 1
    if out and out[0][0] != "code" and 0 < first < len(out[0][1]):
        kind, body, start = out[0]
        ends = [m.end() for m in END.finditer(body) if m.end() <= first]
        space = body.rfind(" ", 0, first)
        cut = ends[-1] if ends else space + 1 if space > 0 else first
        cutted = [(kind, p.strip(), start + a + len(p) - len(p.lstrip())) for p, a in ((body[:cut], 0), (body[cut:], cut))]
        out = [c for c in cutted if c[1]] + out[1:]
    return [(f"c{i + 1:03d}", i, k, t, s, s + len(t)) for i, (k, t, s) in enumerate(out)]


def found(spark, texts, **sizes):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in chunks.chunk(docs, **sizes).orderBy("doc_id", "index").collect():
        out[r["doc_id"]].append(tuple(r)[1:])
    return [out[i] for i in range(len(texts))]


CASES = [
    None,
    "",
    "   \n\n   \t  ",
    "This is a single paragraph of moderate length.",
    "# First Heading\n\nSome content.\n\n# Second Heading\n\nMore content.",
    "  indented first line\nsecond \n\n 　# odd heading \nend",
    "This is a sentence with a reasonable amount of words in it. " * 40,
    "Here is some intro.\n\n```python\ndef hello():\n    return 'world'\n```\n\nAnd some outro.",
    "a" * 1700,
    "blockchain " * 200,
    "```python\n" + "print('x')\n" * 200 + "```",
    "# " + "Word " * 400,
    "```python\n" + "print('hello')\n" * 80 + "```",
    ("This is a moderately long sentence with several words. " * 25).rstrip(),
    "  ".join(["A short sentence here."] * 25),
    "\n".join(["A sentence that ends with a period."] * 15),
    "text\n```\nnever closed\n# no heading\n\n\n",
    "``` one line\n```\n```\nagain\n```tail\nend",
    "x\n" * 3 + "\n" + "Long. " * 400 + "y" * 2000 + " z. " + "w " * 900 + "end",
    "é😀" * 900 + ". " + "ü " * 500,
    "b" * 395 + ".    " + "c" * 20,
    "b" * 405,
    "\r\n\r\nword\x85\r\n\x1c# no\n\x1f\n",
]


def test_cases_against_brute_force(spark):
    for text, got in zip(CASES, found(spark, CASES), strict=True):
        assert got == brute(text), text


@pytest.mark.parametrize("sizes", [{"most": 20, "target": 12, "first": 6}, {"most": 9, "target": 9, "first": 0}, {"most": 40, "target": 5, "first": 40}])
def test_random_texts_against_brute_force(spark, sizes):
    rng = random.Random(7)
    parts = ["a", "bc", " ", "  ", ". ", "! ", "?\n", "\n", "\n\n", "```", "\n```\n", "# ", "\n#", "word", "é", "😀", " ", "\x1d", "longerword", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(400)]
    for text, got in zip(texts, found(spark, texts, **sizes), strict=True):
        assert got == brute(text, **sizes), (text, sizes)


def test_one_exchange_and_no_python(spark):
    plan = chunks.chunk(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Pandas" not in plan


def test_chunks_of_rows_with_one_id_stay_apart(spark):
    docs = spark.createDataFrame([(None, "a. b"), (None, "a. b"), (1, "# h\nx")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["chunk_id"], r["text"]) for r in chunks.chunk(docs).collect())
    assert got == [(False, "c001", "# h"), (False, "c002", "x"), (True, "c001", "a. b"), (True, "c001", "a. b")]
