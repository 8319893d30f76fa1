"""Spark results beside DuckDB's on the same tables."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, db, f, sql, sf_dir):
    """None if they agree, else what differs."""
    df = f(spark, sf_dir)
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got, want = rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; only here {[r for r in got if r not in want][:3]}, only there {[r for r in want if r not in got][:3]}"
    return next((f"{a} and {b}" for a, b in zip(got, want, strict=True) if a != b), None)
