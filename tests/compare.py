"""Run a query in Spark and its SQL in DuckDB and compare names, types and rows."""

from __future__ import annotations

import math
import os

import duckdb

from slatewise.sources.star import TABLES

KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        db.execute(f"create view {t} as select * from read_parquet('{path}')")
    return db


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1.5e-6
    return a == b


def compare(df, db, sql: str) -> str | None:
    """None when equal, otherwise what differs; doubles may differ in the last rounded digit."""
    found = db.execute(sql)
    kinds = {d[0]: str(d[1]) for d in found.description}
    names = sorted(kinds)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} != {names}"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    bad = {n: (types[n], kinds[n]) for n in names if KINDS.get(types[n]) != kinds[n]}
    if bad:
        return f"types differ: {bad}"
    at = [list(kinds).index(n) for n in names]
    want = sorted(([r[i] for i in at] for r in found.fetchall()), key=_key)
    got = sorted(([r[n] for n in names] for r in df.collect()), key=_key)
    if len(want) != len(got):
        return f"{len(got)} rows, oracle has {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    far = [(g, w) for g, w in wrong if not all(_same(a, b) for a, b in zip(g, w))]
    if far:
        return f"{len(far)} rows differ, first {far[0][0]} != {far[0][1]}"
    if wrong:
        print(f"   note: {len(wrong)} rows differ in the last digit, e.g. {wrong[0]}")
    return None
