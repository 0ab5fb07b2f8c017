"""Run a query and its SQL twin on the same tables and compare rows, names and values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(name: str) -> str:
    name = name.upper()
    if name in ("BIGINT", "LONG"):
        return "long"
    if name in ("INTEGER", "INT"):
        return "int"
    return {"VARCHAR": "string", "STRING": "string", "DOUBLE": "double", "FLOAT": "float", "BOOLEAN": "boolean"}.get(
        name, "timestamp" if name.startswith("TIMESTAMP") else name.lower())


def sort_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def compare(df, con, sql: str) -> list[str]:
    """Differences in words; an empty list means equal."""
    result = con.execute(sql)
    described = result.description
    theirs = result.fetchall()
    names = sorted(d[0] for d in described)
    problems = []
    if sorted(df.columns) != names:
        return [f"columns {sorted(df.columns)} != {names}"]
    kinds = {d[0]: kind(str(d[1])) for d in described}
    for field in df.schema.fields:
        if kind(field.dataType.simpleString()) != kinds[field.name]:
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} != {kinds[field.name]}")
    at = [[d[0] for d in described].index(n) for n in names]
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=sort_key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in theirs), key=sort_key)
    if len(ours) != len(theirs):
        return [*problems, f"rows {len(ours)} != {len(theirs)}"]
    if not ours:
        problems.append("no rows")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        a, b = wrong[0]
        diff = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
        problems.append(f"{len(wrong)} rows differ, first {diff}")
    return problems
