import random
import sys
from pathlib import Path

import numpy as np

from geoweft.llm import bitsliced as B
from geoweft.llm import registry

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import same  # noqa: E402


def test_equals_sql(spark):
    assert same(spark, registry.QUERIES["op4_top_k"], registry.ORACLES["op4_top_k"], "/root/testdata/sf0.01") == 50


def test_index_finds_all_of_the_best():
    r = np.random.default_rng(3)
    for n, upper in ((5, 6), (70, 1), (700, 4), (700, 12)):
        x = r.integers(-900, 900, (n, 16))
        index = B.Index(x, upper)
        for q in (*r.integers(-900, 900, (5, 16)), np.zeros(16, np.int64), x[0]):
            score = x @ q
            assert set(np.argsort(-score, kind="stable")[:10]) <= set(index.top(q, 10, np.array([], int)))


def test_defined_cases(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([-0.5, 0.25, 0.5]) for _ in range(4)]) for i in range(300)]
    rows += [(1000, None), (1001, []), (1002, [0.1, None, 0.1, 0.1]), (1003, [float("nan")] * 4), (1004, [2.4e6, 0.0, 0.0, 0.0]), (1005, [-2.2e6, 2.15e6, 1.0, 0.0]), (1200, [2.3e6, 2.2e6, -0.3, 0.0]), (1300, []), (None, [0.5] * 4), (1100, [0.5, 0.5]), (7, rows[7][1])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, rank int")
    ok = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if i is not None and (i < 1000 or i in (1001, 1004, 1005, 1100, 1200, 1300))]
    want = []
    for q, f in [x for x in ok if x[0] % 100 == 0]:
        best = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, e in ok if i != q and len(e) == len(f))[:10]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    for size in ({}, {"per_block": 40}):
        assert sorted(map(tuple, B.nearest(df, **size).collect())) == sorted(want)
    assert B.nearest(df.limit(0)).collect() == []


def test_components_of_any_size(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [3e6, 1.0]), (2, [0.5, 0.5]), (100, [1e300, 1.0]), (3, [-1e300, 0.0]), (4, [2e300, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in B.nearest(df).orderBy("query_id", "rank").collect()]
    top, low = 2**63 - 1, -(2**63)
    assert got[:5] == [(0, 4, top), (0, 100, top), (0, 1, 1024 * (3_000_000 * 1024 + 1024)), (0, 2, 1024 * 1024), (0, 3, low)]
    assert [x[1] for x in got[5:]] == [4, 1, 0, 2, 3]
    wide = spark.createDataFrame([(i, [1048.0 * i, -1500.5]) for i in range(300)], "vec_id long, embedding array<double>")
    ok = {i: [1048 * i * 1024, -1500.5 * 1024] for i in range(300)}
    for q in (0, 100, 200):
        want = sorted((-int(sum(a * b for a, b in zip(ok[q], e))), i) for i, e in ok.items() if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in B.nearest(wide).where(f"query_id = {q}").orderBy("rank").collect()] == want
