"""Runs a registered query and its SQL over the same tables and compares them."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in at) for r in rows)


def _plain(x):
    if x is None:
        return (0, "")
    if isinstance(x, bool):
        return (1, str(int(x)))
    if isinstance(x, (list, tuple)):
        return (2, str([_plain(y) for y in x]))
    if isinstance(x, float):
        return (1, repr(0.0 if x == 0 else x) if math.isfinite(x) and x != int(x) else str(int(x)) if math.isfinite(x) else repr(x))
    if isinstance(x, int):
        return (1, str(x))
    return (1, str(x))


def same(spark, query, sql, data=DATA):
    found = query(spark, data)
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    made = con.execute(sql)
    columns = [c[0] for c in made.description]
    assert sorted(columns) == sorted(found.columns), (sorted(columns), sorted(found.columns))
    want, have = rows_of(columns, made.fetchall()), rows_of(found.columns, [tuple(r) for r in found.collect()])
    assert len(want) == len(have), (len(want), len(have))
    wrong = [(a, b) for a, b in zip(want, have) if a != b]
    assert not wrong, f"{len(wrong)} of {len(want)} rows differ: {wrong[:2]}"
    return len(have)
