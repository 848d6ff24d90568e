"""Ranked full-text search over messages and notes.

The index is a table of postings, one row for each stem and document, and one of
document lengths.  A query joins its few stems with the postings; only the k best
documents are joined back to their texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.shared import materialize

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"
# Latin letters with a mark, and their bare form, by Unicode decomposition.
_MARKED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.combining(unicodedata.normalize("NFD", chr(c))[-1])]


def fold(c: Column) -> Column:
    """Lower-cased text, Latin letters without their marks."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.translate(low, "".join(m for m, _ in _MARKED), "".join(b for _, b in _MARKED))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def query_terms(text: str, stemmed: bool = False) -> list[list[str]]:
    """Each blank-separated term as the tokens (or stems) of its phrase; quotes and terms without tokens are dropped."""
    out = []
    for term in text.split():
        folded = "".join(dict(_MARKED).get(ch, ch) for ch in term.replace('"', "").lower())
        words = re.findall(r"[^\W_]+", folded)
        if words:
            out.append([stem(w) for w in words] if stemmed else words)
    return out


# The suffixes of steps 2, 3 and 4 of the stemmer, longer ones of step 4 first.
_TWO = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_THREE = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_FOUR = tuple(sorted(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), key=len, reverse=True))
#: The rules of a step, and all its suffixes, as most words have none of them.
_STEPS = tuple((rules, tuple(a for a, _ in rules)) for rules in (_TWO, _THREE))


def stem(word: str) -> str:
    """Porter's suffix stripping (1980), in its five published steps."""
    # no suffix of the five steps ends in another character
    if len(word) <= 2 or word[-1] not in "cdegilmnrstuy" or not word.isascii():
        return word

    def shape(s: str) -> str:
        out, last = "", ""
        for i, ch in enumerate(s):
            kind = "v" if ch in "aeiou" or (ch == "y" and i > 0 and last == "c") else "c"
            out += kind if kind != last else ""
            last = kind
        return out

    measure = lambda s: shape(s).count("vc")
    vowel = lambda s: "v" in shape(s)

    def full(s: str) -> str:
        out, last = "", ""
        for i, ch in enumerate(s):
            last = "v" if ch in "aeiou" or (ch == "y" and i > 0 and last == "c") else "c"
            out += last
        return out

    double = lambda s: len(s) > 1 and s[-1] == s[-2] and full(s)[-1] == "c"
    cvc = lambda s: len(s) > 2 and full(s)[-3:] == "cvc" and s[-1] not in "wxy"
    w = word
    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: len(w) - len(a)] + b
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for a in ("ed", "ing"):
            if w.endswith(a) and vowel(w[: -len(a)]):
                w = w[: -len(a)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules, suffixes in _STEPS:
        for a, b in rules if w.endswith(suffixes) else ():
            if w.endswith(a):
                w = w[: -len(a)] + b if measure(w[: -len(a)]) > 0 else w
                break
    for a in _FOUR if w.endswith(_FOUR) else ():
        if w.endswith(a):
            base = w[: -len(a)]
            if measure(base) > 1 and (a != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and double(w) and measure(w) > 1 else w


#: Rows of an index: postings (term, kind, id, tf, positions), lengths (kind, id, tf) and forms (term, word) in one table.
ROWS = "part string, term string, kind string, id long, tf long, positions array<int>, word string"
#: Words of a piece of a document, words that are inverted at once, and words whose stems a task keeps.
PIECE, AT_ONCE, KEPT = 128, 1 << 18, 1 << 16


def index_rows(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """The rows of an index over docs (kind, id, content), made where the texts are read.

    The postings of a document need no exchange: it crosses to Python in pieces of
    few words, one after another, as a batch has a number of rows and not of words.
    The words of whole documents are numbered, sorted by term and document, and cut
    where these change, some ``AT_ONCE`` words at a time.  A word is stemmed, and
    its form written, when a task has not kept its stem; forms repeat.  Only
    documents that share kind and id are brought together.
    """
    keys = docs.groupBy("kind", "id").count().filter("count > 1").select(F.col("kind").alias("k"), F.col("id").alias("i"))
    if keys.isEmpty():
        return _inverted(docs, stemmed)
    same = docs["kind"].eqNullSafe(F.col("k")) & docs["id"].eqNullSafe(F.col("i"))
    shared = _inverted(docs.join(keys, same, "left_semi"), stemmed).groupBy("part", "term", "kind", "id", "word")
    shared = shared.agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return _inverted(docs.join(keys, same, "left_anti"), stemmed).unionByName(shared)


def _inverted(docs: DataFrame, stemmed: bool) -> DataFrame:
    names = [c.split()[0] for c in ROWS.split(", ")]
    types = pa.schema([("part", pa.string()), ("term", pa.string()), ("kind", pa.string()), ("id", pa.int64()), ("tf", pa.int64()), ("positions", pa.list_(pa.int32())), ("word", pa.string())])

    def made(part: str, n: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["part"] = pa.array([part], pa.string()).take(pa.array(np.zeros(n, np.int64)))
        return pa.RecordBatch.from_arrays([columns[c].cast(types.field(c).type) if c in columns else pa.nulls(n, types.field(c).type) for c in names], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, plain, rest = [], str.maketrans(dict(_MARKED)), None

        @lru_cache(KEPT)
        def root(word: str) -> str:
            fresh.append((stem(word) if stemmed else word, word))
            return fresh[-1][0]

        def inverted(pieces: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Rows of whole documents."""
            begins = np.flatnonzero(pieces.column("piece").to_numpy() == 0)
            sizes = np.add.reduceat(pieces.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), begins)
            kind, number = pieces.column("kind").take(pa.array(begins)), pieces.column("id").take(pa.array(begins))
            yield made("lengths", len(sizes), kind=kind, id=number, tf=pa.array(sizes))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            if not len(doc):
                return
            at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = pieces.column("words").flatten().dictionary_encode()
            # marks go after the cut into words, as letters stay letters without them
            stems = pa.array([root(w if w.isascii() else w.translate(plain)) for w in found.dictionary.to_pylist()], pa.string())
            if fresh:
                yield made("forms", len(fresh), term=pa.array([s for s, _ in fresh], pa.string()), word=pa.array([w for _, w in fresh], pa.string()))
                fresh.clear()
            stems = stems.dictionary_encode()
            ascending = pc.sort_indices(stems.dictionary).to_numpy()
            place, terms = np.argsort(ascending), stems.dictionary.take(pa.array(ascending))
            key = place[stems.indices.to_numpy()][found.indices.to_numpy()] * len(sizes) + doc
            order = np.argsort(key, kind="stable")
            key = key[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            owner = pa.array(key[cuts[:-1]] % len(sizes))
            positions = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at[order], pa.int32()))
            yield made("postings", len(owner), term=terms.take(pa.array(key[cuts[:-1]] // len(sizes))), kind=kind.take(owner), id=number.take(owner), tf=pa.array(np.diff(cuts)), positions=positions)

        def bounded(pieces: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Rows of whole documents, those that begin within the same ``AT_ONCE`` words at a time."""
            before = np.cumsum(pieces.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            begins = np.flatnonzero(pieces.column("piece").to_numpy() == 0)
            turn = np.concatenate([[0], before])[begins] // AT_ONCE
            cuts = [*begins[np.flatnonzero(np.diff(turn, prepend=-1))], pieces.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield from inverted(pieces.slice(a, b - a))

        for b in batches:
            rest = b if rest is None else pa.concat_batches([rest, b])
            begins = np.flatnonzero(rest.column("piece").to_numpy() == 0)
            if not len(begins):
                continue
            # the last document may go on in the next batch
            whole, rest = rest.slice(0, begins[-1]), rest.slice(begins[-1])
            yield from bounded(whole)
        if rest is not None and rest.num_rows:
            yield from bounded(rest)

    low = F.lower(F.coalesce("content", F.lit("")))
    cut = F.regexp_extract_all(low, F.lit(rf"(?:{TOKEN}[^\p{{L}}\p{{N}}]*+){{1,{PIECE}}}+"), F.lit(0))
    pieces = docs.select("kind", F.col("id").cast("long").alias("id"), F.posexplode_outer(cut).alias("piece", "text"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0))
    return pieces.select("kind", "id", F.coalesce("piece", F.lit(0)).alias("piece"), words.alias("words")).mapInArrow(run, ROWS)


def index_tables(docs: DataFrame, stemmed: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (term, kind, id, tf, positions), lengths (kind, id, length) and forms (stem, term) of docs (kind, id, content).

    Terms are stems, or words as they are.  The texts are read once.
    """
    rows = materialize(index_rows(docs, stemmed), "index-rows")
    of = lambda part: rows.filter(F.col("part") == part)
    lengths = of("lengths").select("kind", "id", F.col("tf").cast("int").alias("length"))
    return of("postings").select("term", "kind", "id", "tf", "positions"), lengths, of("forms").select(F.col("term").alias("stem"), F.col("word").alias("term")).distinct()


def index(docs: DataFrame, stemmed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of :func:`index_tables`, for one query."""
    return index_tables(docs, stemmed)[:2]


def matches(postings: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """kind, id, phrase (its number), tf: documents that have all phrases, and how often each."""
    spark = postings.sparkSession
    rows = [(n, len(p), k, w) for n, p in enumerate(phrases) for k, w in enumerate(p)]
    wanted = F.broadcast(spark.createDataFrame(rows, "phrase int, words int, step int, term string"))  # the query's own words
    starts = postings.join(wanted, "term").select("kind", "id", "phrase", "words", F.transform("positions", lambda p: p - F.col("step")).alias("starts"))
    # a phrase stands where all its words agree on the start
    placed = starts.groupBy("kind", "id", "phrase", "words").agg(F.collect_list("starts").alias("starts")).filter(F.size("starts") == F.col("words"))
    common = F.aggregate(F.slice("starts", 2, 1 << 20), F.element_at("starts", 1), lambda acc, s: F.array_intersect(acc, s))
    found = placed.select("kind", "id", "phrase", F.size(common).alias("tf")).filter("tf > 0")
    whole = found.groupBy("kind", "id").agg(F.count("*").alias("n")).filter(F.col("n") == len(phrases)).select("kind", "id")
    return found.join(whole, ["kind", "id"])


def search(postings: DataFrame, lengths: DataFrame, text: str, stemmed: bool = True) -> DataFrame:
    """T5: kind, id, score of every document that matches all terms; each kind is scored by its own statistics."""
    phrases = query_terms(text, stemmed)
    if not phrases:
        return lengths.select("kind", "id", F.lit(0.0).alias("score")).limit(0)
    found = materialize(matches(postings, phrases), "found")
    size = lengths.groupBy("kind").agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    have = found.groupBy("kind", "phrase").agg(F.count("*").alias("n_have"))
    # one row for each kind and phrase
    stats = F.broadcast(have.join(size, "kind"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - F.col("n_have") + 0.5) / (F.col("n_have") + 0.5)))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return found.join(stats, ["kind", "phrase"]).join(lengths, ["kind", "id"]).groupBy("kind", "id").agg(F.sum(idf * tf).alias("score"))


def documents_of(messages: DataFrame, notes: DataFrame) -> DataFrame:
    """kind, id, content, at of messages and notes."""
    return messages.select(F.lit("message").alias("kind"), "id", "content", F.col("created_at_unix").alias("at")).unionByName(notes.select(F.lit("note").alias("kind"), "id", "content", F.col("timestamp").cast("double").alias("at")))


def ranked(hits: DataFrame, docs: DataFrame, sort: str = "relevance", limit: int = 50) -> DataFrame:
    """K3: the first hits by relevance, newest or oldest (rows without a time last); other sorts count as relevance."""
    limit = min(max(limit, 1), 100)
    best = hits.join(docs.select("kind", "id", "at"), ["kind", "id"])
    order = {"newest": F.col("at").desc_nulls_last(), "oldest": F.col("at").asc_nulls_last()}.get(sort, F.round("score", 9).desc())
    return best.orderBy(order, "kind", "id").limit(limit)


def snippet(content: Column, words: list[str], most: int = 40) -> Column:
    """A stretch of at most ``most`` tokens around the first of the words, these marked, with ellipses where it is cut."""
    pieces = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(rf"{TOKEN}[^\p{{L}}\p{{N}}]*"), F.lit(0))
    bare = lambda x: fold(F.regexp_extract(x, TOKEN, 0))
    first = F.array_position(F.transform(pieces, lambda x: bare(x).isin(*words)), True)
    start = F.greatest(F.lit(1), first - most // 2)
    part = F.transform(F.slice(pieces, start.cast("int"), most), lambda x: F.when(bare(x).isin(*words), F.concat(F.lit("<mark>"), F.regexp_extract(x, TOKEN, 0), F.lit("</mark>"), F.regexp_replace(x, f"^{TOKEN}", ""))).otherwise(x))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.rtrim(F.array_join(part, "")), F.when(F.size(pieces) > start + most - 1, "…").otherwise(""))


def strip_marks(c: Column) -> Column:
    """A snippet without its marks."""
    return F.regexp_replace(c, r"</?mark>", "")


# --- an index in storage ---------------------------------------------------------
#
# A folder of Parquet tables; each change is a segment with a number of its own:
# postings and the forms of stems (in the order of the terms) and lengths for added
# documents, ids for removed ones.  A document of segment n is there unless a later
# segment removes it.  Nothing that is written is changed.

#: The folder of what has a term, and that of lengths.  A task writes one file in each, however many terms it has.
TERMS, NO_TERM = 0, -1


def segments(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the segments of an index; those that are not whole have no mark and do not count."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []


def _finish(spark: SparkSession, path: str, n: int) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done/{n}")
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True).close()


_GONE = "kind string, id long"


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of an index, over its whole segments, with their number: rows of one part, or what was removed."""
    schema, below = (_GONE, f"{path}/gone") if name == "gone" else (ROWS, f"{path}/rows")
    parts = [f"{below}/segment={n}" for n in segments(spark, path)]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    parts = [p for p in parts if fs_path(p).getFileSystem(conf).exists(fs_path(p))]
    schema += ", segment int" if name == "gone" else ", segment int, bucket int"
    rows = spark.read.schema(schema).option("basePath", below).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return rows if name == "gone" else rows.filter((F.col("part") == name) & ((F.col("bucket") == NO_TERM) if name == "lengths" else (F.col("bucket") >= TERMS)))


def _lengths(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "lengths").select("kind", "id", F.col("tf").cast("int").alias("length"), "segment")


def _alive(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Rows of documents that no later segment removed."""
    gone = _table(spark, path, "gone").groupBy("kind", "id").agg(F.max("segment").alias("removed"))
    return rows.join(gone, ["kind", "id"], "left").filter(F.col("removed").isNull() | (F.col("removed") < F.col("segment"))).drop("removed", "segment")


def add_documents(docs: DataFrame, path: str, stemmed: bool = True) -> int:
    """A segment with the documents (kind, id, content) that the index in ``path`` lacks; its number."""
    spark = docs.sparkSession
    n = max(segments(spark, path), default=-1) + 1
    if n:
        docs = docs.join(_alive(_lengths(spark, path), spark, path).select("kind", "id"), ["kind", "id"], "left_anti")
    rows = index_rows(docs, stemmed).withColumn("bucket", F.when(F.col("term").isNull(), NO_TERM).otherwise(TERMS))
    # terms in order, so that a reader finds its own by the bounds of the pages
    rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/segment={n}")
    _finish(spark, path, n)
    return n


def remove_documents(gone: DataFrame, path: str) -> int:
    """T4: a segment that removes documents (kind, id); its number."""
    spark = gone.sparkSession
    n = max(segments(spark, path), default=-1) + 1
    gone.select("kind", "id").distinct().write.mode("overwrite").parquet(f"{path}/gone/segment={n}")
    _finish(spark, path, n)
    return n


def read_index(spark: SparkSession, path: str, text: str, stemmed: bool = True) -> tuple[DataFrame, DataFrame]:
    """T4: what a query needs of a saved index: postings of its terms, from their pages alone, and the lengths."""
    words = sorted({w for p in query_terms(text, stemmed) for w in p})
    postings = _table(spark, path, "postings").filter(F.col("term").isin(words))
    return _alive(postings.select("term", "kind", "id", "tf", "positions", "segment"), spark, path), _alive(_lengths(spark, path), spark, path)


def saved_forms(spark: SparkSession, path: str, text: str) -> list[str]:
    """The words in use whose stems a query has, from a saved index; as many as it has forms."""
    words = sorted({w for p in query_terms(text, stemmed=True) for w in p})
    rows = _table(spark, path, "forms").filter(F.col("term").isin(words)).select("word").distinct()
    return sorted(r["word"] for r in rows.collect())
