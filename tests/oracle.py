"""Runs a registered query and its SQL on the same tables and compares rows whatever their order."""

from __future__ import annotations

import glob
import math

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    con = connection(sf_dir)
    con.execute("set timezone = 'UTC'")
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    have, want = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    assert len(have) == len(want), f"{len(have)} rows, {len(want)} by SQL"
    wrong = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    assert not wrong, f"{len(wrong)} rows differ: {wrong[:3]}"
