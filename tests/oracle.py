"""Compare a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, name)}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, int):
        return int(value)
    return str(value)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(con, df, sql: str) -> tuple[bool, str]:
    got_cols = df.columns
    got = normal([tuple(r) for r in df.collect()], got_cols)
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = normal(cur.fetchall(), want_cols)
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return False, f"rows {len(got)} vs {len(want)}; first differences {diff}"
    return True, f"{len(got)} rows"
