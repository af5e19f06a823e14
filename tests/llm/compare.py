"""Holds a query against its SQL on DuckDB: same columns, same rows."""

import math
from pathlib import Path

import duckdb


def duck(sf_dir, **frames):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    for name, frame in frames.items():
        connection.execute(f"DROP VIEW IF EXISTS {name}")
        connection.register(name, frame)
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def same(frame, connection, sql):
    got = sorted((tuple(plain(r[c]) for c in sorted(frame.columns)) for r in frame.collect()), key=str)
    result = connection.sql(sql)
    names = list(result.columns)
    assert sorted(names) == sorted(frame.columns)
    at = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
    assert got == want
    return len(got)
