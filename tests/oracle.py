"""Run a query and its SQL twin and compare the results."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def _normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.12g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = [tuple(_normal(row[i]) for i in order) for row in rows]
    kinds = {}
    for row in data:
        for name, value in zip(names, row):
            if value is not None:
                kinds.setdefault(name, set()).add(_kind(value))
    return names, sorted(data, key=repr), kinds


def compare(spark, connection, sf_dir, function, sql):
    """None when equal, else a text that says how the results differ."""
    frame = function(spark, sf_dir)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}", len(ours[1])
    if ours[2] != theirs[2]:
        return f"types {ours[2]} != {theirs[2]}", len(ours[1])
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}", len(ours[1])
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}", len(ours[1])
    return None, len(ours[1])
