"""Tables written to the folder that the driver and all executors share.

Lineage is cut by writing a table and reading it again, so that a lost executor
costs a re-read and not a recomputation.  The folder is the session's
``spark.checkpoint.dir``; where that is unset, only a session on one machine
(master ``local``) may use a folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """URI of a shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/") + "/convlake/" + spark.sparkContext.applicationId


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table as read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that no pending plan reads."""
    spark, path = df.sparkSession, df._shared_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def put_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Write bytes to the shared folder; the URI can go to ``SparkContext.addFile``."""
    path = f"{folder(spark)}/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; to be called when its results are written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
