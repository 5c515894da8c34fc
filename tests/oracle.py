"""Compare queries with their SQL: names of columns, rows in any order, values after a common rounding."""

import glob
import math
import os

import duckdb

from querent.session import TABLES


def views(folder):
    link = duckdb.connect()
    link.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if glob.glob(path):
            link.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return link


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return f"{value:.0f}" if abs(value) < 2**53 else str(value)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.replace(tzinfo=None)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def differences(spark, folder, query, sql):
    got = query(spark, folder)
    found = views(folder).execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    have = rows_of(got.columns, [tuple(r) for r in got.collect()])
    if have[0] != want[0]:
        return f"columns {have[0]} and {want[0]}"
    if len(have[1]) != len(want[1]):
        return f"{len(have[1])} and {len(want[1])} rows: {[r for r in have[1] if r not in want[1]][:3]} {[r for r in want[1] if r not in have[1]][:3]}"
    wrong = [(a, b) for a, b in zip(have[1], want[1], strict=True) if a != b]
    return f"{len(wrong)} rows differ: {wrong[:2]}" if wrong else ""
