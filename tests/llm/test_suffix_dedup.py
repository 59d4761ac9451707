import hashlib
import random

import numpy as np

from geoweft.llm import suffix_dedup as S
from geoweft.llm.registry import QUERIES


def brute(rows, length=200):
    seen, out = {}, []
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for i in range(len(d) - length + 1):
            h = hash(d[i : i + length])
            seen[h] = seen.get(h, 0) + 1
    for (i, _), d in zip(rows, data):
        cover = np.zeros(len(d) + 1, int)
        for s in range(len(d) - length + 1):
            if seen[hash(d[s : s + length])] > 1:
                cover[s] += 1
                cover[s + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0 if len(d) else np.zeros(0, bool)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(d) else 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone]) if len(d) else b""
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_against_brute_force(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdeé", k=r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(400), text(60)
    rows = [(1, base), (2, base), (3, None), (4, ""), (5, "x" * 900), (6, "short"), (7, passage[:200]), (8, text(50) + passage + text(50)), (9, "ab" * 130), (10, base[:900] + text(5) + base[903:1500]), (1, base), (None, text(30) + passage)]
    for i in range(40):
        words = base.split()
        for _ in range(r.randrange(1, 12)):
            words[r.randrange(len(words))] = word()
        rows.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n int")
    got = [tuple(x) for x in S.dedup(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert S.dedup(docs.limit(0)).collect() == []


def test_statistics_of_the_index():
    r = random.Random(1)
    spans = ["".join(r.choices("ab", k=r.randrange(1, 40))).encode() for _ in range(30)] + [b"abab" * 20, b"abab" * 20 + b"b"]
    index = S.RunLengthIndex(spans)
    text = index.text.tolist()
    n = len(text)
    want = []
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
        want.append(best)
    assert index.statistics().tolist() == want and index.runs < n


def test_segments_give_the_same_anchors(monkeypatch):
    r = random.Random(2)
    data = bytes(r.choices(b"abcdefgh ", k=5000))
    whole = S.anchors(data, 200, 32)
    monkeypatch.setattr(S, "BITS", 10)
    starts = lambda x: {(s, h, p) for h, p, a, b in x.tolist() for s in range(a, b + 1)}
    assert {s for s, _, _ in starts(S.anchors(data, 200, 32))} == {s for s, _, _ in starts(whole)} == set(range(4801))


def test_query_equals_brute_force(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = [tuple(x) for x in QUERIES["op10_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(brute(rows))


def test_no_index_holds_a_frequent_anchor_whole(spark, monkeypatch):
    r = random.Random(7)
    text = lambda n: "".join(r.choices("abcdefghij ", k=n))
    line, passage = "0123456789" * 4, text(260)
    rows = [text(r.randrange(200, 400)) + line + text(r.randrange(200, 400)) for _ in range(300)]
    rows += [text(r.randrange(150)) + passage[:130] + line + passage[130:] + text(r.randrange(150)) for _ in range(150)]
    rows += [rows[i][:k] + "#" + rows[i][k + 1 :] for i in range(20) for k in (100, 420)] + ["x" * 500, "x" * 300]
    at_once, plain = 20_000, S.RunLengthIndex

    class Bounded(plain):
        def __init__(self, spans):
            assert sum(map(len, spans)) <= 3 * at_once, "one index over every span of an anchor"
            super().__init__(spans)

    monkeypatch.setattr(S, "RunLengthIndex", Bounded)
    texts = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(rows)], "k1 long, text string, n int")
    gone = [np.zeros(len(t), bool) for t in rows]
    for x in S.repeated(texts, 200, 32, at_once).collect():
        gone[x.k1][x.start : x.stop] = True
    assert [int(g.sum()) for g in gone] == [x[2] for x in brute(list(enumerate(rows)))]
    kept = [hashlib.sha256(bytes(np.frombuffer(t.encode(), np.uint8)[~g])).hexdigest() for t, g in zip(rows, gone)]
    assert kept == [x[4] for x in brute(list(enumerate(rows)))]


def test_anchors_are_made_and_shuffled_once(spark, monkeypatch):
    import re

    plans = []
    monkeypatch.setattr(S, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    S.dedup(spark.createDataFrame([(1, "a" * 300), (2, "a" * 300 + "b")], "doc_id long, text string"))
    plain = [re.sub(r"[\s:|+-]+", " ", re.sub(r"#\d+L?", "", line)) for line in plans[0].splitlines()]
    filters = [plain[i + 1] for i, line in enumerate(plain) if "RepartitionByExpression [h]" in line]
    assert len(filters) == 2 and len(set(filters)) == 1
