import sys
from pathlib import Path

from pyspark.sql import functions as F

from geoweft.llm import line_dedup as L
from geoweft.llm import registry

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import same  # noqa: E402

LONG = "this line is long enough to be told apart from chance"


def test_equals_sql(spark):
    assert same(spark, registry.QUERIES["op8_line_dedup"], registry.ORACLES["op8_line_dedup"], "/root/testdata/sf0.01") == 1000


def test_defined_cases(spark):
    rows = [(1, f"start one\n{LONG}\nend"), (2, f"{LONG.upper()}  \n  {LONG}"), (3, None), (4, ""), (5, "short\nshort\nshort"), (2, f"{LONG.upper()}  \n  {LONG}"), (None, LONG), (6, "x y " * 30000 + "\n" + LONG)]
    docs = spark.createDataFrame([(*r, "keep", 1) for r in rows], "doc_id long, text string, digest string, place int")
    out = L.dedup(docs)
    assert out.columns == [*docs.columns, "__removed", "__passages"] and out.count() == len(rows)
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text == rows[0][1] and by[1][0]["__removed"] == []
    for r in by[2]:
        assert r.text == "" and [tuple(x) for x in r["__removed"]] == [(0, len(rows[1][1]))]
    assert by[3][0].text is None and by[4][0].text == "" and by[5][0].text == rows[4][1]
    assert by[None][0].text == "" and by[6][0].text == "x y " * 30000 + "\n"
    assert L.summary(docs).count() == len(rows)
    again = {r.doc_id: r.text for r in L.dedup(docs, most_hot=1).collect()}
    assert again == {i: rs[-1].text for i, rs in by.items()}
    assert L.summary(docs.limit(0)).collect() == []


def test_paragraphs(spark):
    para = LONG + "\n" + LONG + " again"
    docs = spark.createDataFrame([(1, f"a\n\n{para}\n\nb"), (2, f"{para}\n\nown text")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in L.dedup(docs, unit="paragraph").collect()}
    assert kept == {1: f"a\n\n{para}\n\nb", 2: "own text"}
    assert L.dedup(docs, unit="paragraph").where(F.size("__removed") > 0).count() == 1


def test_a_passage_shows_in_first_and_later_places(spark):
    lines = [f"line {k} of a passage that several documents hold in full" for k in range(4)]
    passage = "\n".join([*lines[:2], "short", *lines[2:]])
    docs = spark.createDataFrame([(1, f"own words before it, long enough\n{passage}\nand own words after it as well"), (2, passage), (3, lines[0] + "\nwords of its own, not said elsewhere"), (4, "nothing that anybody else has ever said")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed > 0, r.n_passage_chars) for r in L.summary(docs).collect()}
    assert got == {1: (False, len(passage) + 1), 2: (True, len(passage)), 3: (True, 0), 4: (False, 0)}


def test_hot_digests_take_the_other_join(spark):
    rows = [(i, f"{LONG}\nthe own line of document number {i}") for i in range(3000)]
    out = L.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where(F.size("__removed") == 1).count() == 2999
    assert out.where("doc_id = 0").first().text == rows[0][1] and out.where("doc_id = 7").first().text == "the own line of document number 7"
