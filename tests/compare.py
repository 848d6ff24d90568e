"""A query's rows against those of its SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return repr(v.tolist())
    if v is None or v is pd.NA or v != v:
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(df, columns):
    return sorted(tuple(shown(v) for v in r) for r in df[columns].astype(object).values.tolist())


def assert_equal(spark, sf, query, sql):
    got = query(spark, sf).toPandas()
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = c.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))
