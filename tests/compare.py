"""Compare a Spark result with a SQL result of the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def open_tables(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


def sql_rows(con, sql: str):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in sorted(names)]
    rows = [tuple(r[i] for i in order) for r in result.fetchall()]
    return sorted(names), sorted(map(repr, rows))
