"""Holds a query against its SQL on DuckDB: same columns, same rows."""

import math
from pathlib import Path

import duckdb


def duck(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of(frame):
    return sorted((tuple(plain(r[c]) for c in sorted(frame.columns)) for r in frame.collect()), key=str)


def rows_by_sql(connection, sql):
    result = connection.sql(sql)
    names = list(result.columns)
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
