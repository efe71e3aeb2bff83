"""Run a query and its SQL twin on the same Parquet files and compare all values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(folder) / name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    try:
        return float(value)
    except (TypeError, ValueError):
        return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    data.sort(key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
    return [columns[i] for i in order], data


def differences(df, con, sql: str) -> list[str]:
    got_columns, got = table_of(df.columns, df.collect())
    result = con.execute(sql)
    want_columns, want = table_of([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return [f"columns {got_columns} and {want_columns}"]
    if len(got) != len(want):
        return [f"rows {len(got)} and {len(want)}"]
    bad = [f"{g} and {w}" for g, w in zip(got, want) if g != w]
    out = [f"{len(bad)} of {len(got)} rows differ"] + bad[:4] if bad else []
    spark_types = [t for _, t in sorted(df.dtypes)]
    duck_types = [str(t[1]) for t in sorted((d[0], d[1]) for d in result.description)]
    for c, s, d in zip(got_columns, spark_types, duck_types):
        if KIND.get(s, s) != KIND.get(d, d):
            out.append(f"type of {c}: {s} and {d}")
    return out


KIND = {
    "bigint": "int64", "BIGINT": "int64", "int": "int32", "INTEGER": "int32", "double": "float", "DOUBLE": "float",
    "string": "text", "VARCHAR": "text", "boolean": "bool", "BOOLEAN": "bool",
}
