"""Comparison of a Spark result with DuckDB's result of the same query."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


def differences(df, con, sql: str) -> list[str]:
    """What differs: columns, number of rows, or up to three rows on either side."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = {c: i for i, c in enumerate(names)}
    want = sorted((tuple(plain(r[at[c]]) for c in order) for r in want), key=repr)
    if len(got) == len(want) and all(same(a, b) for a, b in zip(got, want)):
        return []
    return [f"{order}; {len(got)} rows and {len(want)}"] + [f"spark {a}\n    sql {b}" for a, b in zip(got, want) if not same(a, b)][:3]


def same(a, b) -> bool:
    return len(a) == len(b) and all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b))
