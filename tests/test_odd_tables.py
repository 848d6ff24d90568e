"""Queries against their SQL on tables with rows that the smallest testbed lacks."""

from pathlib import Path

import pytest
from compare import TABLES, assert_equal

from convlake.plans.catalog import oracle_sql, queries


@pytest.fixture
def changed(spark, sf, tmp_path):
    """A folder of the tables, some of them replaced by DataFrames."""

    def made(**tables):
        for t in TABLES:
            if t in tables:
                tables[t].toPandas().to_parquet(tmp_path / f"{t}.parquet", coerce_timestamps="us")
            else:
                (tmp_path / f"{t}.parquet").symlink_to(Path(sf) / f"{t}.parquet")
        return str(tmp_path)

    return made


def check(spark, folder, name):
    assert_equal(spark, folder, queries()[name], oracle_sql()[name])


def test_stream_dedup_leaves_out_what_breaks_the_contract(spark, changed):
    """Too large bodies, bodies that are null, composed and decomposed letters, and blanks at the end."""
    texts = ["x" * 65_537, "x" * 70_001, "x" * 65_536, "y" * 262_145, "éa", "éa ", "ab \u0085", "ab ", "ab", None, None]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    check(spark, changed(documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")), "stream_capture_dedup")
