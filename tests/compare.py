"""Runs a query and its SQL twin and compares rows without regard to order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        if Path(f"{folder}/{table}.parquet").exists():
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, sql: str, db) -> str:
    """'' when equal, else a short account of the first differences."""
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    expected = rows_of(names, result.fetchall())
    actual = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns: spark {sorted(df.columns)} sql {sorted(names)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    plain = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "FLOAT": "float"}
    odd = {n: (spark_types[n], types[n]) for n in names if plain.get(types[n], spark_types[n]) != spark_types[n] or types[n] in ("HUGEINT",) or types[n].startswith("DECIMAL")}
    if expected != actual:
        missing, extra = list((expected - actual).items()), list((actual - expected).items())
        short = lambda items: [str(i)[:400] for i in items[:2]]
        return f"rows: sql {sum(expected.values())} spark {sum(actual.values())}; only sql {len(missing)} {short(missing)}; only spark {len(extra)} {short(extra)}"
    return f"types: {odd}" if odd else ""
