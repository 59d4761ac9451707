import sys
from pathlib import Path

from geoweft.llm import licenses as L
from geoweft.llm import registry

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import same  # noqa: E402


def test_equals_sql(spark):
    assert same(spark, registry.QUERIES["op9_license_scan"], registry.ORACLES["op9_license_scan"], "/root/testdata/sf0.01") > 5


def test_defined_cases(spark):
    header = dict(L.TEMPLATES)["gpl-3.0"]
    rows = [(1, "text\nReleased under the MIT license\nmore"), (2, None), (3, ""), (4, "word"), (5, header.replace(". ", ".\n")), (1, "text\nReleased under the MIT license\nmore"),
            (6, "nothing to see here at all"), (7, "x " * 200_000 + "\nAll Rights Reserved!"), (None, "Licensed under CC BY-NC 4.0."), (8, header.replace("software", "thing"))]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, license string")
    found = {(r.doc_id, r.line): (r.license, r.dice) for r in L.scan(docs).collect()}
    assert found[1, 1] == ("mit", 1.0) and found[7, 1] == ("all-rights-reserved", 1.0) and found[None, 0] == ("cc-by-nc-4.0", 1.0)
    assert found[5, -1] == ("gpl-3.0", 1.0) and found[8, 0][0] == "gpl-3.0" and 0.8 <= found[8, 0][1] < 1
    assert not {k for k in found if k[0] in (2, 3, 4, 6)} and L.scan(docs.limit(0)).collect() == []


def test_keys_lose_no_match():
    for _, text in L.TEMPLATES:
        grams = L.bigrams_of(text)
        low, high, n = L.bounds(len(grams), 0.8)
        assert 1 <= low <= len(grams) <= high and 1 <= n <= len(grams)
        assert 2 * (len(grams) - n) / (len(grams) - n + len(grams)) < 0.8  # a unit without a key bigram
