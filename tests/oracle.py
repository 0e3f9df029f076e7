"""Run a query and its SQL on one folder of tables and compare rows."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return None if v != v else round(v, 9)
        if isinstance(v, list | tuple):
            return tuple(plain(x) for x in v)
        return None if v is None or v is pd.NaT or v is pd.NA else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def compare(spark, query, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{folder}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    want = con.sql(sql).df()
    got = query(spark, folder).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert normal(got) == normal(want)
    return len(got)
