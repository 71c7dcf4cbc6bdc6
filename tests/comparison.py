"""Comparison of a Spark result with DuckDB running the twin SQL."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else ("f", value)
    if isinstance(value, datetime.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    return (type(value).__name__, value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def differences(df, con, sql: str) -> list[str]:
    """What differs: names, types, row counts, then the first differing rows."""
    told = con.execute(sql)
    names = [c[0] for c in told.description]
    types = {c[0]: str(c[1]) for c in told.description}
    expected = told.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    found = []
    for name, kind in df.dtypes:
        if _KINDS.get(kind) != types[name]:
            found.append(f"type of {name}: {kind} != {types[name]}")
    got = _rows(df.columns, df.collect())
    want = _rows(names, expected)
    if not want:
        found.append("no rows")
    if len(got) != len(want):
        found.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        extra = [row for row in got if row not in set(want)][:3]
        lacking = [row for row in want if row not in set(got)][:3]
        found.append(f"only here {extra}; only there {lacking}")
    return found
