"""Compare a Spark query with its SQL in DuckDB: row count, column names and types, and sorted values."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(result: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    """What differs, in words; empty when nothing does."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]).upper() for d in cursor.description}
    expected = _rows(names, cursor.fetchall())
    found = _rows(result.columns, [tuple(row) for row in result.collect()])
    problems = []
    if sorted(names) != sorted(result.columns):
        return [f"columns {sorted(result.columns)} instead of {sorted(names)}"]
    for field in result.schema.fields:
        wanted = SPARK_TYPES.get(field.dataType.simpleString(), field.dataType.simpleString().upper())
        if wanted != types[field.name]:
            problems.append(f"type of {field.name}: {wanted} instead of {types[field.name]}")
    if len(found) != len(expected):
        problems.append(f"{len(found)} rows instead of {len(expected)}")
    else:
        wrong = [(f, e) for f, e in zip(found, expected, strict=True) if f != e]
        if wrong:
            problems.append(f"{len(wrong)} of {len(found)} rows differ, first {wrong[0][0]} instead of {wrong[0][1]}")
    return problems
