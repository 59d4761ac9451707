import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from geoweft.llm import language_id as L

SYLLABLES = {"aa": "ka to mi ru sa ne", "bb": "sch ung heit lich ber zu", "cc": "ción mente ado eza rr ll"}


def made(n=240):
    r, rows = random.Random(3), []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(r.choices(SYLLABLES[lang].split(), k=r.randrange(1, 5))) for _ in range(r.randrange(5, 60))]
        rows.append((i, " ".join(words), lang, "s", "clash"))
    rows += [(1000, None, "aa", "s", ""), (1001, "", None, "s", ""), (1002, "123 456 !!", "bb", "s", ""), (1003, "ka to mi " * 40000, None, None, None), (0, rows[0][1], "aa", "s", "")]
    return rows


def test_held_out_accuracy_and_defined_cases(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string, lang string, source string, score string")
    rows = L.identify(docs).collect()
    assert len(rows) == 245
    truth = {r[0]: r[2] for r in made()[:240]}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in rows}
    for i in (1000, 1001, 1002):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in rows)
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.where(F.col("doc_id").isin(1000, 1001, 1002)).count() == 0


def test_empty_and_unlabelled(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(docs).collect()] == ["und"]
    assert L.identify(docs.limit(0)).collect() == []


def test_codewords():
    for n in range(2, 12):
        code = L.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n
        assert (abs(code.sum(0)) < n).all()
        assert len({tuple(c * c[0]) for c in code.T.tolist() for c in [np.array(c)]}) == code.shape[1]
    code = L.codewords(60)
    assert len({tuple(c) for c in code.tolist()}) == 60 and len({tuple(c) for c in code.T.tolist()}) == code.shape[1]


def test_decoding_is_the_plain_weighted_loss():
    r = np.random.default_rng(3)
    code = L.codewords(9)
    m = L.Model([f"l{k}" for k in range(9)], code, r.normal(0, 1, (L.DIM, code.shape[1])), r.normal(0, 1, code.shape[1]), r.random(code.shape[1]))
    x = L.gram_counts("some words of a text")
    f = [sum(x[i] * m.weight[i, b] for i in np.flatnonzero(x)) + m.bias[b] for b in range(code.shape[1])]
    loss = [sum(m.trust[b] * np.log(1 + np.exp(-f[b] * c[b])) for b in range(len(f))) for c in code]
    p = np.exp(-np.array(loss))
    assert np.allclose(m.decode(x[None])[0], p / p.sum())


def test_one_language_many_languages_and_ties(spark):
    one = spark.createDataFrame([(i, f"words {i}", "aa") for i in range(8)] + [(99, "other", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(one).collect()} == {"aa"}
    r, rows = random.Random(9), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    for i in range(600):
        lang = i % 12
        rows.append((i, " ".join("".join(r.choices(letters[2 * lang : 2 * lang + 3], k=4)) for _ in range(30)), f"l{lang:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, most_texts=120)
    assert len(model.languages) == 12 and model.code.shape[0] == 12
    got = L.identify(docs).where("held_out").collect()
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in got]) > 0.9
    same = spark.createDataFrame([(i, "one text", f"l{i % 2}") for i in range(40)], "doc_id long, text string, lang string")
    tied = L.identify(same).collect()
    assert len({(x.lang_pred, round(x.score, 6)) for x in tied}) == 1
