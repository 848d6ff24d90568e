"""Files with given names and contents, written by the executors, and what lies in a folder."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.shared import materialize


def place(folder: str):
    """The file system of a folder (a URI, or a path on a mount that all executors share) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def write_one(files, path: str, data: bytes, replace: bool) -> str:
    """Write under a name of its own and rename: a reader never sees half a file, and a repeated task does no harm."""
    from pyarrow import fs

    info = files.get_file_info(path)
    if info.type == fs.FileType.File:
        if info.size == len(data):
            with files.open_input_stream(path) as f:
                if f.read() == data:
                    return "present"
        if not replace:
            return "kept"
    files.create_dir(posixpath.dirname(path), recursive=True)
    own = posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}.tmp")
    with files.open_output_stream(own) as f:
        f.write(data)
    files.move(own, path)
    return "replaced" if info.type == fs.FileType.File else "written"


def write_files(rows: DataFrame, folder: str, replace: bool = False) -> DataFrame:
    """Write each row (path, content) to a file in ``folder``; path and status of each.

    ``written``; ``present``: it was there with this content; ``kept``: it was there
    with another one (``replaced`` with ``replace``); ``refused``: the path is empty,
    absolute or leads out of the folder.  Null contents are empty files.  Of rows
    with one path the first by content is written, so that the result does not
    depend on their order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = place(folder)
        for b in batches:
            status = []
            for path, content in zip(b["path"], b["content"], strict=True):
                bad = not path or path.startswith("/") or ".." in path.split("/")
                status.append("refused" if bad else write_one(files, posixpath.join(base, path), (content or "").encode(), replace))
            yield pd.DataFrame({"path": b["path"], "status": status})

    once = rows.groupBy("path").agg(F.min("content").alias("content"))
    return materialize(once.mapInPandas(run, "path string, status string"), "written-files")


def listing(spark: SparkSession, folder: str, uri: bool = False) -> DataFrame:
    """path (in the folder) and size of all files below ``folder``; their contents are not read, and empty files are left out.

    With ``uri``, the file's whole path too, as a reader of its lines has it.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(within(F.col("_metadata.file_path"), folder).alias("path"), F.col("length").alias("size"), *([F.col("_metadata.file_path").alias("uri")] if uri else []))


def within(path, folder: str):
    """The part of a file's URI below ``folder``."""
    bare = folder.split("://", 1)[-1].rstrip("/")
    return F.substring_index(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), f"{bare}/", -1)


def texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (in the folder) and content of the text files below ``folder``."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return found.select(within(F.col("_metadata.file_path"), folder).alias("path"), F.col("value").alias("content"))
