"""Runs a registered query and its SQL on DuckDB and compares columns, types and rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

FAMILY = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=5e-7) or (math.isnan(a) and math.isnan(b))
    return a == b


def sort_key(row):
    return tuple((v is None, str(round(v, 4)) if isinstance(v, float) else str(v)) for v in row)


def differences(df, con, sql: str) -> list[str]:
    names = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*names).collect()]
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    theirs = cursor.fetchall()
    if names != sorted(theirs_names):
        return [f"columns {names} vs {sorted(theirs_names)}"]
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(row[i] for i in order) for row in theirs]
    problems = []
    for name in names:
        kind = df.schema[name].dataType.simpleString()
        if FAMILY.get(kind) != types[name]:
            problems.append(f"type of {name}: {kind} vs {types[name]}")
    if len(ours) != len(theirs):
        return problems + [f"rows {len(ours)} vs {len(theirs)}"]
    bad = [
        (a, b)
        for a, b in zip(sorted(ours, key=sort_key), sorted(theirs, key=sort_key))
        if not all(same(x, y) for x, y in zip(a, b))
    ]
    if bad:
        problems.append(f"{len(bad)} of {len(ours)} rows differ, first {bad[0]}")
    if not ours:
        problems.append("no rows")
    return problems
