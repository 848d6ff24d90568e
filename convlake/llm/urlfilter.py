"""URL filtering with a sorted digest array.

The keys of a rule list are kept as one file: 64-bit xxhash digests in ascending
order, then the full strings.  Every executor fetches the file once, each task
memory-maps it, probes it with vectorised binary search and compares the stored
string wherever a digest is met, so that a collision can't decide.

A rule is a host and a path prefix (``net/es/``: host ``net``, path ``/es/``); it
fits the host itself and all its subdomains.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.shared import put_bytes

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: What holds for a url that no rule fits.
OTHERWISE = "allow"
#: Most bytes of a digest file; a longer list is split over several passes.
FILE_BYTES = 256 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if the url is null or has none."""
    rest = after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def digests(strings: Iterable[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings), np.uint64)


class DigestArray:
    """Sorted 64-bit digests with a payload byte and the full string of each key."""

    def __init__(self, path: str):
        head = np.memmap(path, np.int64, "r", shape=(1,))
        n = int(head[0])
        self.keys = np.memmap(path, np.uint64, "r", 8, (n,)) if n else np.zeros(0, np.uint64)
        self.at = np.memmap(path, np.int64, "r", 8 + 8 * n, (n + 1,))
        self.values = np.memmap(path, np.uint8, "r", 16 + 16 * n, (n,)) if n else np.zeros(0, np.uint8)
        self.blob = np.memmap(path, np.uint8, "r", 16 + 17 * n) if n else np.zeros(0, np.uint8)

    @staticmethod
    def pack(entries: dict[str, int]) -> bytes:
        """File contents for strings with a payload from 0 to 255 each."""
        raw = [s.encode("utf-8", "surrogatepass") for s in entries]
        keys = digests(entries)
        order = np.argsort(keys, kind="stable")
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(raw[i]) for i in order], out=at[1:])
        values = np.fromiter(entries.values(), np.uint8, len(raw))[order]
        return np.array([len(raw)], np.int64).tobytes() + keys[order].tobytes() + at.tobytes() + values.tobytes() + b"".join(raw[i] for i in order)

    def find(self, strings: list[str]) -> np.ndarray:
        """Payload of each string, or -1."""
        out = np.full(len(strings), -1, np.int64)
        if not len(self.keys) or not strings:
            return out
        keys = digests(strings)
        place = np.searchsorted(self.keys, keys, "left")
        for i in np.flatnonzero(np.asarray(self.keys[np.minimum(place, len(self.keys) - 1)]) == keys):
            raw, j = strings[i].encode("utf-8", "surrogatepass"), place[i]
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.blob[self.at[j] : self.at[j + 1]].tobytes() == raw:
                    out[i] = self.values[j]
                    break
                j += 1
        return out


def suffixes(host: str, most: int) -> list[str]:
    """The host and its parent domains of at most ``most`` characters, longest first."""
    out = [host] if len(host) <= most else []
    at = host.find(".", max(0, len(host) - most - 1))
    while at >= 0:
        if len(host) - at - 1 <= most:
            out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def judge(files: dict[str, str], lengths: list[int], longest_host: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hosts, rules = (DigestArray(SparkFiles.get(files[k])) for k in ("hosts", "rules"))
    for batch in batches:
        pairs = list(zip(batch["host"], batch["path"], strict=True))
        # which parent domains carry rules at all, then the rules of those
        domains = [(row, d) for row, (host, _) in enumerate(pairs) for d in suffixes(host, longest_host)]
        hit = hosts.find([d for _, d in domains]) >= 0
        tries = [(row, d + path[:n]) for (row, d), ok in zip(domains, hit, strict=True) if ok for path in (pairs[row][1],) for n in lengths if n <= len(path)]
        rule: list[str | None] = [None] * len(pairs)
        verdict: list[str | None] = [None] * len(pairs)
        for (row, key), value in zip(tries, rules.find([k for _, k in tries]), strict=True):
            if value >= 0 and (rule[row] is None or len(key) > len(rule[row])):
                rule[row], verdict[row] = key, "allow" if value else "block"
        yield batch.assign(rule=pd.Series(rule, batch.index, object), verdict=pd.Series(verdict, batch.index, object))


def parts(rules: list[tuple[str, str]], most: int) -> Iterator[list[tuple[str, str]]]:
    """The rule list in pieces whose digest files stay below ``most`` bytes."""
    piece, size = [], 0
    for rule in rules:
        cost = 17 + len(rule[0].encode("utf-8", "surrogatepass"))
        if piece and size + cost > most:
            yield piece
            piece, size = [], 0
        piece.append(rule)
        size += cost
    if piece:
        yield piece


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, otherwise: str = OTHERWISE, id_col: str = "page_id", url_col: str = "url", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Id, host, path, rule and verdict of every row; the longest fitting rule wins.

    A rule needs its path to be a prefix of the url's, so a url without any path
    fits no rule.  Null urls and such without ``://`` have an empty host and path,
    no rule and the verdict ``otherwise``.  Rules given twice: the last verdict
    holds.  Repeated or null ids are rows like others; no rows: no rows.  Columns
    other than the id and the url are ignored, whatever their names.
    """
    spark = pages.sparkSession
    out = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url_col)), F.lit("")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    schema = out.schema
    for piece in parts(list(dict(rules).items()), file_bytes):
        entries = {k: int(v == "allow") for k, v in piece}
        domains = {k.partition("/")[0]: 1 for k in entries}
        mark, files = uuid.uuid4().hex, {}
        for kind, content in (("rules", entries), ("hosts", domains)):
            uri = put_bytes(spark, f"{kind}-{mark}.digests", DigestArray.pack(content))
            spark.sparkContext.addFile(uri)
            files[kind] = os.path.basename(uri)
        lengths = sorted({len(k) - len(k.partition("/")[0]) for k in entries})
        longest = max(map(len, domains))
        out = better(out, files, lengths, longest, schema)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(otherwise)))


def better(rows: DataFrame, files: dict[str, str], lengths: list[int], longest: int, schema) -> DataFrame:
    """Rows with the longer of the rule that they have and the one found in these files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []

        def seen() -> Iterator[pd.DataFrame]:
            for b in batches:
                kept.append(b)
                yield b

        for new in judge(files, lengths, longest, seen()):
            old = kept.pop(0)
            keep = old["rule"].fillna("").str.len() > new["rule"].fillna("").str.len()
            new.loc[keep, ["rule", "verdict"]] = old.loc[keep, ["rule", "verdict"]]
            yield new

    return rows.mapInPandas(run, schema)
