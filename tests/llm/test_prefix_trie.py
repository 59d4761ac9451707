import hashlib
import random
import sys
import zlib
from pathlib import Path

from geoweft.llm import prefix_trie as P
from geoweft.llm import registry

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import same  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, key int, path int, n int"


def plain(rows):
    """Every node by listing the prefixes of every conversation."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, ts in own.items():
        ts.sort(key=lambda t: (t[0], t[1], t[2], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))
        own[c] = [t[2:] for t in ts]
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    saved, leaves = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += kids[p] == 0
    out = []
    for p, ms in members.items():
        ends = ",".join(map(str, sorted(c for c in ms if made[c] == p)))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in P.report(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)).collect()), key=str)


def test_equals_sql(spark):
    assert same(spark, registry.QUERIES["op12_prefix_trie"], registry.ORACLES["op12_prefix_trie"], "/root/testdata/sf0.01") > 300


def test_equals_brute_force(spark):
    r = random.Random(3)
    rows = []
    for c in [*range(40), *range(100, 230), 70_000, 9_000_000_000, -3, -100, -205]:
        for t in range(r.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "ab", "ñandú 😀"]) if t < 3 else f"{t % 4}"))
    rows += [(None, 0, "user", "x"), (7, None, None, None), (7, None, "user", "first"), (7, 3, "user", "twice"), (7, 3, "user", "twice"), (8, 1, "user", ""), (8, 1, "", "user")]
    r.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_long_and_repeated_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (1, 2, 3, 901, 902) for t in range(60 if c != 3 else 45)] + [(5, t, "user", f"own {t}") for t in range(300)]
    rows += [(c, t, "user", "all the same") for c in range(2000, 2400) for t in range(2)]
    assert got(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert got(spark, [(1, 0, "user", "x")]) == plain([(1, 0, "user", "x")])
    assert P.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plans_do_not_grow_with_depths(spark):
    """Conversations that part at every depth take a round each; the plan of the result names as many tables for 24 depths as for 6."""
    from geoweft.llm import prefix_trie

    def tables_named(depth):
        rows = [(c, t, "user", f"{t}" if t < c else f"{t} of {c}") for c in range(1, depth + 1) for t in range(1, c + 1)]
        found = prefix_trie.trie(prefix_trie.turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
        assert found.count() > depth
        return found._jdf.queryExecution().optimizedPlan().collectLeaves().size()

    assert tables_named(6) == tables_named(24)
