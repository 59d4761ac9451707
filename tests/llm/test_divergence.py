import random
import re
import sys
from collections import Counter
from pathlib import Path

from geoweft.llm import divergence as D
from geoweft.llm import registry

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import same  # noqa: E402

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, source string, term string, n int, doc_id long"


def plain(rows, vocab=None):
    """(lang, source, part, item, value, rank), every term for every pair."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(A_TO_Z))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df, all_ = Counter(t for d in own for t in set(d[2])), Counter(t for d in own for t in d[2])
        terms = sorted((t for t in df if df[t] >= 3), key=lambda t: (-all_[t], t.encode()))[:vocab]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in set(terms)) for s in {d[1] for d in own}}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(terms)) for t in terms} for s, c in counts.items()}
        total = sum(all_[t] for t in terms)
        q = {t: 1 + 10**9 * (all_[t] + 1) // (total + len(terms)) for t in terms}
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in terms)) for o in p if o != s]
            words = [(t, f(p[s][t], q[t])) for t in terms if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", words, 200)):
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def some(seed, n=120):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdéñ" for b in ("", "X", "yy", "日本")]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", "-", "1", "\n", "\x00"]) for _ in range(k))
    rows = [(text(r.choice([0, 2, 30])), r.choice(["en", "de", None, ""]), r.choice(["s", "S", "t", None, "ü", "zz"])) for _ in range(n)]
    return rows + [(None, "en", "only empty"), ("rare words here", "xx", "a"), ("other ones", "xx", "b"), ("alone", "yy", "c"), (rows[0][0], *rows[0][1:]), (text(20_000), "en", "long")]


def test_equals_sql(spark):
    assert same(spark, registry.QUERIES["op11_source_divergence"], registry.ORACLES["op11_source_divergence"], "/root/testdata/sf0.01") > 1000


def test_equals_brute_force(spark, monkeypatch):
    rows = some(1)
    docs = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)
    assert rows_of(D.audit(docs)) == plain(rows)
    assert rows_of(D.audit(docs, vocab_size=7)) == plain(rows, 7)
    assert D.audit(docs.limit(0)).collect() == []


def test_blocks_tiles_and_full_tasks_change_nothing(spark, monkeypatch):
    rows = some(2)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    true = D.pair_values
    monkeypatch.setattr(D, "pair_values", lambda e, g: true(e, g, tile=2, block=20))
    whole = D.sums
    monkeypatch.setattr(D, "sums", lambda d: whole(d, at_once=10))
    assert rows_of(D.audit(docs)) == plain(rows)


def test_long_texts_go_by_shares_of_terms(monkeypatch):
    monkeypatch.setattr(D, "LONG_TEXT", 50)
    monkeypatch.setattr(D, "CHUNK", 7)
    parts = list(D.vectors(("ab cd ab ñ " * 40).encode()))
    assert len(parts) > 1 and sum(parts, Counter()) == {b"ab": 80, b"cd": 40, "ñ".encode(): 40} and sum(len(p) for p in parts) == 3
