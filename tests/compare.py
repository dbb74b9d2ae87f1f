"""Runs a query and its SQL on the same tables and compares rows."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in records), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def difference(spark, sf_dir, query, sql):
    """None if equal, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    want = rows(names, cur.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    for a, b in zip(got, want, strict=True):
        if any(x != y and not (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-12 * abs(y)) for x, y in zip(a, b, strict=True)):
            return f"{a} / {b}"
    return None
