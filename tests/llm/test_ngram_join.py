import random
import re

from geoweft.llm import ngram_join as J
from geoweft.llm.registry import QUERIES

DATA = "/root/testdata/sf0.01"


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    near = {(a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in near:
        o = len(sets[a] & sets[b])
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_made_groups_by_narrow_and_wide_columns(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows, base = [], r.choices(words, k=150)
    for i in range(60):
        copy = list(base)
        for _ in range(r.randrange(6)):
            copy[r.randrange(150)] = r.choice(words)
        rows.append((i, " ".join(copy)))
    passage = " ".join(r.choices(words, k=40))
    rows += [(100 + i, " ".join(r.choices(words, k=r.randrange(3, 60))) + " " + passage) for i in range(80)]
    rows += [(300, None), (301, ""), (302, "a b"), (303, "A  B"), (304, "a b c"), (305, "é É"), (306, "x y z " * 20000), (307, "x y z " * 19999)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component int")
    want = brute(rows)
    for wide in (4, 8, 24):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.join(docs, wide=wide).collect()}
        assert got == want
    assert {x.doc_id for x in J.keep_one(docs).collect()} == {c for _, c in want.values()}
    assert J.join(docs.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in QUERIES["op6_ngram_join"](spark, DATA).collect()}
    assert got == brute(rows)


def test_no_task_meets_a_whole_wide_column(spark, monkeypatch):
    plain = J._possible

    def bounded(n, p, m, q, percent):
        assert len(m) <= 7_000, "a whole column in one task"
        return plain(n, p, m, q, percent)

    monkeypatch.setattr(J, "_possible", bounded)
    parts = {k: 1 if k > 3 else -k for k in range(1, 12_001)}
    rows = [(5, k, 100, 0, c, 11_997 if c == 1 else 1) for k, c in parts.items()] + [(6, k, 100, 0, 1, 11_997) for k in range(50)]
    rows += [(7, k, 50 + k, k % 40, 100 + k % 3, 20) for k in range(60)]
    got = {(x.key, x.component, x.cell) for x in J.crossing(spark.createDataFrame(rows, "shingle long, key long, n int, place int, component long, held long"), 75).collect()}
    want = {(k, -k, 1) for k in (1, 2, 3)} | {(a, -a, -b) for a in (1, 2, 3) for b in (1, 2, 3) if -b < -a}
    want |= {(a, 100 + a % 3, 100 + b % 3) for a in range(60) for b in range(60) if b % 3 < a % 3 and plain(50 + a, a % 40, 50 + b, b % 40, 75)}
    assert got == want


def test_null_and_repeated_ids(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, long), (7, long), (7, long), (3, long + " x"), (3, "other words stand here and there"), (None, "alone with its own words here"), (9, None), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, __text string")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in J.join(docs).collect()), key=str)
    assert got == sorted([(None, 8, 3), (7, 8, 3), (7, 8, 3), (3, 9, 3), (3, 2, 3), (None, 2, None), (9, 0, 9), (9, 0, 9), (None, 0, None)], key=str)
    left = J.keep_one(docs.drop("__text")).collect()
    assert sorted(((x.doc_id, x.text) for x in left), key=str) == sorted([(3, long + " x"), (3, "other words stand here and there"), (None, "alone with its own words here"), (9, None), (9, None), (None, "")], key=str)
    same = spark.createDataFrame([(1, long), (1, long), (2, long), (None, long)], "doc_id long, text string")
    assert [(x.doc_id, x.text) for x in J.keep_one(same).collect()] == [(1, long)]
    assert J.keep_one(same.where("doc_id is null")).count() == 1


def test_blocks_and_lanes_of_one_cell(spark):
    """Cells far over their sizes give the same classes."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    base = r.choices(words, k=90)
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(r.randrange(5)):
            copy[r.randrange(90)] = r.choice(words)
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.join(docs, wide=2, per_block=300, per_lane=7).collect()}
    assert got == want


def test_different_sets_that_share_a_key(spark, monkeypatch):
    true = J.digest
    weak = lambda s: (1 + true(s)[0] % 3, true(s)[1])
    monkeypatch.setattr(J, "digest", weak)
    monkeypatch.setattr(J, "key_of", lambda s, renamed: renamed.get(weak(s), weak(s)[0]))
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[k : k + 30])) for k in range(0, 30, 5)] + [(100 + k, " ".join(words[k : k + 30] + ["more"])) for k in range(0, 30, 5)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs).collect()} == brute(rows)
