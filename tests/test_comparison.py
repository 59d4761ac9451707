import contextlib
import io
import random

from geoweft.operators import roads


def test_percentiles_without_a_list_of_every_row(spark):
    r = random.Random(5)
    rows = [(r.random() * 25_000, 1.0, 1.0 + (i % 50 == 0), r.randrange(10**6), r.randrange(30)) for i in range(3000)]
    found = roads.comparison(spark.createDataFrame(rows, "distance_m double, cost_a double, cost_b double, nodes_a long, nodes_b long"))
    got = {x.bucket: x for x in found.collect()}
    limits = {"0-2 km": (0, 2000), "2-5 km": (2000, 5000), "5-20 km": (5000, 20_000), "total": (0, 20_000)}
    assert set(got) == set(limits)
    for name, (low, high) in limits.items():
        inside = [x for x in rows if low <= x[0] < high]
        a, b = sorted(x[3] for x in inside), sorted(x[4] for x in inside)
        assert got[name].n_pairs == len(inside) and got[name].mismatches == sum(x[1] != x[2] for x in inside)
        assert (got[name].p50_nodes_a, got[name].p95_nodes_b) == (a[int(len(a) * 0.5)], b[int(len(b) * 0.95)])
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        found.explain("extended")
    assert "collect_list" not in plan.getvalue()
    one = roads.comparison(spark.createDataFrame([(1.0, 0.0, 0.0, 7, None)], "distance_m double, cost_a double, cost_b double, nodes_a long, nodes_b long")).collect()
    assert {(x.bucket, x.p50_nodes_a, x.p95_nodes_b) for x in one} == {("0-2 km", 7, None), ("total", 7, None)}
