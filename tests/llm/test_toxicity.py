import random
import zlib

import numpy as np

from geoweft.llm import toxicity as T

BAD, GROUP = ["vile", "scum", "rotten"], ["folk", "tribe"]


def made(n=900):
    r, docs, labels = random.Random(4), [], []
    plain = [f"w{k}" for k in range(300)]
    for i in range(n):
        words = r.choices(plain, k=r.randrange(5, 60))
        bad, group = r.random() < 0.5, r.random() < 0.5
        words += [r.choice(BAD)] * bad + [r.choice(GROUP)] * group
        r.shuffle(words)
        docs.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(bad and group)))  # only together
    return docs, labels


def test_learns_pairs_on_held_out_rows(spark):
    docs, labels = made()
    more = [(5000, None, None), (5001, "", None), (5002, "w1 " * 100_000, "xx"), (3, docs[3][1], "en")]
    d = spark.createDataFrame(docs + more, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(3, 0, labels[3][2]), (None, 1, 1), (77777, 0, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    rows = T.rate(d, lab).collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r.score <= 1 for r in rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in rows}
    assert by[5000].score == by[5001].score < 0.7
    assert T.keep_clean(d, lab).columns == d.columns


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in T.rate(d, lab).collect()] == [0]
    assert T.rate(d.limit(0), lab.limit(0)).collect() == []


def test_score_is_the_sum_over_pairs():
    r = np.random.default_rng(2)
    m = T.Model(np.arange(30, dtype=np.uint32), 0.3, r.normal(0, 1, 30).astype(np.float32), r.normal(0, 0.5, (30, 8)).astype(np.float32))
    for size in (0, 1, 2, 9):
        at = np.sort(r.choice(30, size, replace=False))
        z = m.bias + sum(float(m.weight[i]) for i in at) + sum(float(m.factor[i] @ m.factor[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        assert abs(m.score(at) - 1 / (1 + np.exp(-z))) < 1e-5


def test_a_term_that_counts_only_beside_another_is_kept():
    r = random.Random(12)
    plain = [f"w{k}" for k in range(200)]
    texts, y = [], []
    for _ in range(4000):
        bad, group = r.random() < 0.3, r.random() < 0.5
        toxic = bad and (group or r.random() < 0.1)
        # the group is named as often in clean texts as in toxic ones
        if not bad and r.random() < 0.25:
            group = False
        texts.append(T.term_set(" ".join(r.choices(plain, k=20) + ["vile"] * bad + ["tribe"] * group)))
        y.append(int(toxic))
    y = np.array(y)
    term = T.hashed("tribe")
    share = [np.mean([np.isin(term[0], t) for t, v in zip(texts, y) if v == c]) for c in (0, 1)]
    assert np.isin(term, T.select(texts, y, 1000, 4, 15.0)).all(), share
