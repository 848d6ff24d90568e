"""Texts to chunks along structure, sentences and words, in DataFrame functions.

A text's lines become rows; running sums over them give offsets, the fences that
are open and the blocks.  A long block is cut by regular expressions and a fold.
One exchange, by document, serves all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest chunk, size at which sentences are flushed, largest first chunk.
MOST, TARGET, FIRST = 1600, 1000, 400
#: Blanks: what Unicode calls white space, and the four separators before it.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same ones as a string, for trims: they look at a text's ends only, and a regular expression at every character.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def lead(c: Column) -> Column:
    """Number of blanks at the start."""
    return F.length(F.regexp_extract(c, rf"^[{WS}]*", 0))


def blocks(docs: DataFrame) -> DataFrame:
    """B1: row (a number for each document), doc_id, block, kind, text, start: fenced code, headings and paragraphs.

    A fence is open after an odd number of fence lines, and a closing line belongs to
    its block.  Other lines are headings, blank ones, or paragraphs with the lines
    beside them.
    """
    lines = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    by = Window.partitionBy("row").orderBy("k")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").startswith("```")
    lines = lines.select("*", (F.sum(F.length("line") + 1).over(upto) - F.length("line") - 1).alias("start"), fence.alias("fence"), F.sum(fence.cast("int")).over(upto).alias("fences"))
    bare = F.ltrim("line", F.lit(BLANKS))
    kind = F.when(F.col("fence") | (F.col("fences") % 2 == 1), "code").when(bare.startswith("#"), "heading").when(bare != "", "paragraph")
    lines = lines.withColumn("kind", kind)
    opens = F.when(F.col("kind") == "code", F.col("fence") & (F.col("fences") % 2 == 1)).when(F.col("kind") == "paragraph", ~F.lag("kind").over(by).eqNullSafe("paragraph")).otherwise(F.col("kind").isNotNull())
    lines = lines.withColumn("opens", opens).withColumn("block", F.sum(F.col("opens").cast("int")).over(upto))
    found = lines.filter("kind is not null").groupBy("row", "block").agg(F.first("doc_id").alias("doc_id"), F.min("kind").alias("kind"), F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("lines"))
    whole = F.array_join("lines.line", "\n")
    text = F.when(F.col("kind") == "code", F.rtrim(whole, F.lit("\n"))).otherwise(F.rtrim(whole, F.lit(BLANKS)))
    return found.select("row", "doc_id", "block", "kind", text.alias("text"), "start")


def sliced(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters, cut at the last space where there is one."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{most}}}\z|.{{1,{most - 1}}}(?= )|.{{{most}}}) *"), 1)
    return F.filter(F.transform(pieces, stripped), lambda p: p != "")


def grouped(text: Column, most: int, target: int) -> Column:
    """B2: a long paragraph as groups of sentences; a sentence that is too long is sliced.

    The fold goes over the sentences' lengths and keeps where each group begins: a
    group is closed when the next sentence does not fit or the target is reached.
    """
    sized = lambda s, alone: F.struct(s.alias("t"), F.lit(alone).alias("alone"), F.length(s).alias("n"))
    parts = F.filter(F.transform(F.split(stripped(text), rf"(?<=[.!?])[{WS}]+", -1), stripped), lambda s: s != "")
    pieces = F.flatten(F.transform(parts, lambda s: F.when(F.length(s) <= most, F.array(sized(s, False))).otherwise(F.transform(sliced(s, most), lambda p: sized(p, True)))))
    kind = "struct<i: int, size: int, begins: array<int>>"  # size 0: no group is open
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"), F.expr("cast(array() as array<int>)").alias("begins")).cast(kind)

    def step(done: Column, piece: Column) -> Column:
        n = piece["n"]
        fits = (done["size"] > 0) & ~piece["alone"] & (done["size"] + 1 + n <= most)
        size = F.when(fits, done["size"] + 1 + n).otherwise(n)
        begins = F.when(fits, done["begins"]).otherwise(F.concat(done["begins"], F.array(done["i"])))
        return F.struct((done["i"] + 1).alias("i"), F.when(piece["alone"] | (size >= target), 0).otherwise(size).alias("size"), begins.alias("begins")).cast(kind)

    def groups(found: Column) -> Column:
        begins = F.aggregate(found, start, step)["begins"]
        ends = F.concat(F.slice(begins, 2, F.greatest(F.size(begins) - 1, F.lit(0))), F.array(F.size(found)))
        return F.zip_with(begins, ends, lambda a, b: F.array_join(F.transform(F.slice(found, a + 1, b - a), lambda p: p["t"]), " "))

    return F.transform(F.array(pieces), groups)[0]


def fitted(found: DataFrame, most: int, target: int) -> DataFrame:
    """Blocks as pieces that fit, with the place and start of each; a piece starts one character after the one before."""
    found = found.withColumn("n", F.length("text"))
    long = F.col("n") > most
    texts = F.when(~long, F.array("text")).when(F.col("kind") == "paragraph", grouped(F.col("text"), most, target)).otherwise(sliced(F.col("text"), most))
    kind = F.when(long & (F.col("kind") == "paragraph"), "sentence_group").otherwise(F.col("kind"))
    pieces = found.select("row", "doc_id", "block", kind.alias("kind"), "start", F.posexplode(texts).alias("piece", "text"))
    before = Window.partitionBy("row", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("start", F.col("start") + F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def short_first(first: Column, most: int) -> Column:
    """A chunk (text, start) as a short head, cut at the last sentence end, space or character in reach, and the rest."""
    text, start = first["text"], first["start"]
    sentence = F.length(F.regexp_extract(F.substring(text, 1, most + 1), rf"(?s)^(.*[.!?][{WS}]+)(?=[^{WS}])", 1))
    space = F.length(F.regexp_extract(F.substring(text, 1, most), r"(?s)^(.+ )", 1))
    cut = F.when(sentence > 0, sentence).when(space > 0, space).otherwise(most)
    parts = F.array(F.struct(F.substr(text, F.lit(1), cut).alias("t"), start.alias("s")), F.struct(F.substr(text, cut + 1).alias("t"), (start + cut).alias("s")))
    kept = F.transform(parts, lambda p: F.struct(stripped(p["t"]).alias("text"), (p["s"] + lead(p["t"])).alias("start")))
    return F.filter(kept, lambda p: p["text"] != "")


def chunk(docs: DataFrame, most: int = MOST, target: int = TARGET, first: int = FIRST) -> DataFrame:
    """The chunks of every document (doc_id, text), in order.  Null and blank texts have none."""
    pieces = fitted(blocks(docs.select("doc_id", "text")), most, target)
    order = Window.partitionBy("row").orderBy("block", "piece")
    one = F.struct("text", F.col("start").cast("long").alias("start"))
    shrink = (F.row_number().over(order) == 1) & (F.col("kind") != "code") & (F.length("text") > first) & (F.lit(first) > 0)
    parts = pieces.select("row", "doc_id", "block", "piece", "kind", one.alias("one"), shrink.alias("shrink"))
    parts = parts.select("*", F.posexplode(F.when(F.col("shrink"), short_first(F.col("one"), first)).otherwise(F.array("one"))).alias("part", "c"))
    index = F.row_number().over(Window.partitionBy("row").orderBy("block", "piece", "part")) - 1
    start = F.col("c.start").cast("int")
    chunks = parts.select("doc_id", index.alias("index"), "kind", F.col("c.text").alias("text"), start.alias("char_start"))
    number = (F.col("index") + 1).cast("string")
    name = F.concat(F.lit("c"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))
    return chunks.select("doc_id", name.alias("chunk_id"), "index", "kind", "text", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"))


def chunk_stats(chunked: DataFrame) -> DataFrame:
    """Number and mean size of chunks by kind."""
    return chunked.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 1).alias("mean_chars"), F.max(F.length("text")).alias("max_chars"))
