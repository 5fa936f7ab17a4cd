"""A Spark result against DuckDB: columns, rows, values in any order."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([_plain(x) for x in v])
    if isinstance(v, str):
        return v
    if isinstance(v, int) or type(v).__module__ == "numpy" and "int" in type(v).__name__ or isinstance(v, Decimal) and v == int(v):
        return str(int(v))  # whole numbers are compared exactly
    try:
        return str(int(v)) if float(v).is_integer() and abs(float(v)) < 2**53 else f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


def duck(folder, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    r = c.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def same(df, folder, sql):
    names, rows = duck(folder, sql)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in rows)
    assert len(mine) == len(theirs)
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not wrong, wrong[:3]
