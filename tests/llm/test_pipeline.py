import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline
from pyspark.sql import functions as F  # noqa: E402
from geoweft.llm import language_id, line_dedup, toxicity  # noqa: E402
from test_ngram_join import brute  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, DATA)
        assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            m = language_id.fit(docs)
            want = {i for i, r in before.items() if r.text and language_id.has_letter(r.text) and m.decode(language_id.gram_counts(r.text)[None])[0].max() > 0.5}
            assert set(after) == want
        elif name == "toxicity":
            m = toxicity.fit(docs, labels)
            at = m.lookup()
            assert set(after) == {i for i, r in before.items() if m.score(sorted({k for w in set(r.text.lower().split()) for k in at[w]})) < 0.7}
        elif name == "ngram_join":
            assert set(after) == {c for _, c in brute([(i, r.text) for i, r in before.items()]).values()}
        else:
            seen, want = set(), {}
            for i in sorted(before):
                kept = []
                for a, b in line_dedup.spans(before[i].text, "line"):
                    n = line_dedup.normal(before[i].text[a:b])
                    if len(n) < 24 or n not in seen:
                        kept.append(before[i].text[a:b])
                        seen.add(n)
                want[i] = "".join(kept)
            assert {i: r.text for i, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())
        docs = spark.createDataFrame(list(after.values()), docs.schema)
        sizes.append(len(after))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_stages_take_nulls_repeats_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60)
    schema = docs.schema
    rows = [tuple(r) for r in docs.collect()]
    at = schema.fieldNames().index("text")
    odd = [(None, *rows[5][1:]), rows[6], rows[6], (rows[7][0], *rows[8][1:]), (10**17, *[None] * (len(schema) - 1))]
    odd += [(10**17 + k, *[t if c == at else None for c in range(1, len(schema))]) for k, t in ((1, ""), (2, "12 34"), (3, "one short text in plain words"))]
    wide = spark.createDataFrame(rows + odd, schema)
    for c in ("hash", "key", "cell", "digest", "place", "n", "spans", "places", "__row"):
        wide = wide.withColumn(c, F.lit(c))
    docs, columns = wide, wide.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert docs.columns == columns
        ids = [r.doc_id for r in docs.collect()]
        if name == "language_id":
            assert 10**17 not in ids and 10**17 + 1 not in ids and 10**17 + 2 not in ids
        if name == "ngram_join":
            assert ids.count(rows[6][0]) <= 1 and None not in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.collect()} == set(ids)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide.limit(0), DATA).collect() == []


NAMES = ["__text", "__hit", "__id", "__hash", "__best", "__rows", "__cut", "__key", "__places", "__language", "__toxicity", "hash", "key", "class", "kind", "block", "counts", "slot", "digest", "place"]


def test_columns_of_any_name_come_through(spark):
    line = "a line that two documents hold, long enough to be told apart from chance"
    rows = [(k, f"Some plain words of document number {k} that nobody else says in this order.\n{line}", "en") for k in range(8)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in NAMES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) >= (8 if name == "ngram_join" else 1) or name == "toxicity", name
        assert all(r[c] == f"{c} of {r.doc_id}" for r in got for c in NAMES), name
    again = line_dedup.dedup(docs.withColumn("__removed", F.lit("mine")))
    assert again.columns[-2:] == ["___removed", "__passages"] and {r["__removed"] for r in again.collect()} == {"mine"}
