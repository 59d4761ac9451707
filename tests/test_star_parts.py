import random

from geoweft.operators import components as C
from geoweft.operators import roads


def plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in parent}


def test_long_chains_need_few_rounds(spark, monkeypatch):
    rounds = []
    large = C._large_star
    monkeypatch.setattr(C, "_large_star", lambda edges: rounds.append(1) or large(edges))
    r = random.Random(4)
    chains = [(k, k + 1) for k in range(20_000) if k % 997] + [(50_000 + r.randrange(400), 50_000 + r.randrange(400)) for _ in range(300)]
    r.shuffle(chains)
    docs = spark.createDataFrame(chains, "a long, b long").repartition(6)
    assert {x.node: x.component for x in C.components(docs, near=["a"]).collect()} == plain(chains)
    assert len(rounds) <= 4
    # edges that are anywhere
    assert {x.node: x.component for x in C.components(docs).collect()} == plain(chains)


def test_texts_join_too(spark):
    edges = [("b", "c"), ("a", "c"), ("x", "x"), ("p", "q")]
    assert {x.node: x.component for x in C.components(spark.createDataFrame(edges, "a string, b string").repartition(3)).collect()} == plain(edges)


def test_measures_of_roads_in_parts(spark):
    pts = lambda *xy: [tuple(map(float, p)) for p in xy]
    rows = [
        (1, 1, 1, "LineString", [pts((0, 0), (1, 0))], {"highway": "primary"}), (1, 1, 2, "MultiLineString", [pts((1, 0), (2, 0)), pts((5, 5), (6, 5))], {"maxspeed": "50", "highway": "x"}),
        (1, 1, 3, "LineString", [pts((9, 9), (9, 9))], {}), (1, 1, 4, "Point", None, {}), (2, 1, 1, "Point", None, {}), (1, 2, 1, "LineString", [pts((0, 0), (1, 0))], {}),
    ]
    f = spark.createDataFrame(rows, "dataset long, version_no int, feature_id long, geom_type string, parts array<array<struct<x: double, y: double>>>, attrs map<string, string>")
    got = {(m.dataset, m.version_no): m for m in roads.measures(f).collect()}
    m = got[1, 1]
    assert (m.n_features, m.n_mismatched, m.n_links, m.n_invalid, m.n_components, m.n_no_speed, m.n_no_class) == (4, 1, 3, 1, 2, 1, 0)
    assert (m.minx, m.miny, m.maxx, m.maxy) == (0, 0, 6, 5) and abs(m.largest_ratio - 3 / 5) < 1e-12
    assert got[2, 1].n_links == 0 and got[2, 1].minx is None and got[1, 2].n_components == 1
