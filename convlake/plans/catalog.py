"""All registered queries of the ledger operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convlake.plans import core, meaning, more, records, streams  # noqa: F401
from convlake.plans.registry import ORACLES, QUERIES, Query


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.search_bm25(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
