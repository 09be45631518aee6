"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def canon(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)[:19]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


_FAMILY = {
    "tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "long",
    "double": "double", "float": "double", "varchar": "string", "string": "string",
    "boolean": "boolean", "date": "date",
}


def family(name: str) -> str:
    return _FAMILY.get(name.lower(), name.lower())


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    spark_cols, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    duck_cols, duck_rows = rows_of([d[0] for d in result.description], result.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} vs {duck_cols}"
    mine = {f.name: family(f.dataType.simpleString()) for f in df.schema.fields}
    theirs = {k: family(v) for k, v in types.items()}
    wrong = {k: (mine[k], theirs[k]) for k in mine if mine[k] != theirs[k]}
    if wrong:
        return f"types {wrong}"
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows vs {len(duck_rows)}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            return f"{a} vs {b}"
    return None
