"""Run a registered query and its SQL twin side by side."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "array<bigint>": "BIGINT[]", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "date": "DATE",
}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda j: names[j])
    out = [tuple(plain(r[j]) for j in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, folder, name, fn, sql):
    """Return (problem or None, row count)."""
    df = fn(spark, folder)
    rel = con.execute(sql)
    d_names = [d[0] for d in rel.description]
    s_names = df.columns
    if sorted(d_names) != sorted(s_names):
        return f"columns {sorted(s_names)} vs {sorted(d_names)}", 0
    d_types = {d[0]: str(d[1]) for d in rel.description}
    for c, t in df.dtypes:
        want = TYPES.get(t, t)
        if d_types[c] != want:
            return f"type of {c}: {t} vs {d_types[c]}", 0
    left = rows_of(s_names, [tuple(r) for r in df.collect()])
    right = rows_of(d_names, rel.fetchall())
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}", len(left)
    for a, b in zip(left, right):
        if a != b:
            return f"first difference {a} vs {b}", len(left)
    return None, len(left)
