import random

from geoweft.operators.components import components


def test_against_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {n: root(n) for n in parent}
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_scratch_takes_its_rounds_away(spark, tmp_path):
    import glob
    import os

    import pytest

    from geoweft import tables

    kept = tables.materialize(spark.range(3), "kept")
    with tables.scratch(spark):
        inner = tables.materialize(spark.range(5), "inner")
        paths = [tables._WRITTEN[x].removeprefix("file:") for x in (kept, inner)]
        assert inner.count() == 5 and all(glob.glob(f"{p}/*.parquet") for p in paths)
    assert os.path.exists(paths[0]) and not os.path.exists(paths[1]) and kept.count() == 3
    with pytest.raises(ZeroDivisionError), tables.scratch(spark):
        path = tables._WRITTEN[tables.materialize(spark.range(5), "inner")].removeprefix("file:")
        1 / 0
    assert not os.path.exists(path)
    tables.release(kept)
    assert not os.path.exists(paths[0])
