import hashlib
import random
import re
import sys
from pathlib import Path

import pytest

from geoweft.llm import decontaminate as D
from geoweft.llm import registry

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import same  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(A_TO_Z))


def plain(docs, items, n=10):
    """(doc_id, n_words, n_hit, ids) by comparing every window with every place."""
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).update({str(item)} - {"None"})
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    ids |= windows[x]
        ids = ",".join(sorted(ids))
        out.append((doc, len(w), len(hit), ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_equals_sql(spark):
    assert same(spark, registry.QUERIES["op13_decontaminate"], registry.ORACLES["op13_decontaminate"], "/root/testdata/sf0.01") == 1000


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("at_once", [32 << 20, 45_000])
def test_equals_brute_force(spark, at_once):
    r = random.Random(5)
    some = ["Ünder", "the", "A", "b7", "cat", "sat", "ON", "mat", "ñandú", "x"]
    text = lambda n: "".join(r.choice(some) + r.choice([" ", "\n", ", ", "-", "_", "\x00"]) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 3, 9, 10, 11, 40]))) for k in range(30) if k % 3] + [(100, "the cat sat on a mat x b7 ON x x"), (100, "mat"), (None, "x x x"), (5, None), (6, "..."), (7, "word " * 1500)]
    items += [(k, items[0][1]) for k in range(200, 260)]
    docs = [(k, text(r.choice([0, 5, 50, 300]))) for k in range(40)] + [(50, f"before {items[-20][1]} after"), (51, "The CAT sat-on a_mat X;b7 on x x"), (52, None), (53, ""), (54, "... !"), (None, "x x x"), (55, "word " * 12), (55, "word " * 12), (56, "z " * 30_000 + "x x x" + " q" * 30_000)]
    d, b = frames(spark, docs, items)
    assert sorted((tuple(x) for x in D.report(d, b, at_once=at_once).collect()), key=str) == plain(docs, items)
    assert (D.blocks_of(b, 10, at_once).select("block").distinct().count() > 1) == (at_once == 45_000)


def test_spans_and_documents_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Keep this. {item.upper()}! And this.", "a"), (2, "nothing here", "b"), (3, None, "c"), (4, "one two three four five six seven eight nine", "d"), (5, f"{item} {item}", "e")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, found string, __key int, `_found` int")
    b = spark.createDataFrame([(9, item)], "item_id long, text string")
    cut = D.decontaminate(docs, b)
    assert cut.columns == docs.columns
    got = {r.doc_id: r for r in cut.collect()}
    assert {k: r.text for k, r in got.items()} == {1: "Keep this. ! And this.", 2: "nothing here", 3: None, 4: rows[3][1], 5: ""}
    assert [got[k].found for k in range(1, 6)] == list("abcde")
    assert sorted(r.doc_id for r in D.decontaminate(docs, b, remove="documents").collect()) == [2, 3, 4]
    assert sorted(r.doc_id for r in D.decontaminate(docs, b, remove="documents", least=12).collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        D.decontaminate(docs, b, remove="all")


def test_empty_tables(spark):
    d, b = frames(spark, [(1, "a b c")], [(1, "a b")])
    assert D.report(d.limit(0), b).collect() == []
    assert [tuple(r)[:4] for r in D.report(d, b.limit(0)).collect()] == [(1, 3, 0, 0)]


def test_windows_that_share_a_hash_get_another(monkeypatch):
    true, seen = D.Windows.hashes, []

    def weak(self, ids, long):
        seen.append(int(self.odd[0]))
        return true(self, ids, long) % D.np.uint64(2) if self.odd[0] == seen[0] else true(self, ids, long)

    monkeypatch.setattr(D.Windows, "hashes", weak)
    w = D.Windows([("1", b"a b c d e"), ("2", b"e d c b a")], 3)
    assert len(set(seen)) > 1 and [x["n_hit"] for x in w.scan([b"a b c", b"d e", b"x e d c", None])] == [3, 0, 3, 0]
