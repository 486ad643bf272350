"""Compare a query with its SQL: same columns, same rows, in any order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return normal(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dict):
        return tuple(sorted((str(k), normal(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def spark_kinds(df):
    groups = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float"}
    return {n: groups.get(t, t.split("(")[0]) for n, t in df.dtypes}


def oracle_kinds(con, sql):
    groups = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "string",
              "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
    return {r[0]: groups.get(r[1], r[1].lower()) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
