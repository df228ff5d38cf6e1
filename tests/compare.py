"""Rows of a query in Spark and of its SQL in DuckDB, in a form that can be compared."""

from pathlib import Path

import duckdb
import pandas as pd


def connection(sf_dir: str):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def _plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and v != v:
        return None
    return round(v, 9) if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def both(spark, query, sql: str, sf_dir: str):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    return got, rows_of(rel.columns, rel.fetchall())
