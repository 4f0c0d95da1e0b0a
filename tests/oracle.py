"""Runs a query and its SQL, and compares the rows."""

from __future__ import annotations

import os

DATA = "/root/testdata/sf0.001"


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


def connection(d: str = DATA):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(d):
        name = name.split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{d}/{name}.parquet')")
    return con


def assert_same(spark, query, sql: str, d: str = DATA) -> None:
    got, want = query(spark, d).toPandas(), connection(d).sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
