"""Comparison of a query with its SQL on DuckDB, regardless of the order of rows and columns."""

from __future__ import annotations

import glob
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def assert_same(spark, con, query, sql):
    frame = query(spark, FOLDER)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in frame.collect()], frame.columns) == rows_of(found.fetchall(), columns)
