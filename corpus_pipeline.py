"""The corpus pipeline: identify, filter, deduplicate and pack documents, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.llm import language_id, line_dedup, ngram_join, packing, toxicity
from geoweft.tables import materialize, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language that is likelier than all others together."""
    return language_id.keep_identified(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, taught by the labels, doesn't reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by shared n-grams, the one with the smallest id."""
    return ngram_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur elsewhere stay at their first place; n_chars follows the text."""
    cut = line_dedup.dedup(docs).drop("__removed", "__passages")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it; fewer words are remembered than alone, beside what other stages keep."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=120_000)


STAGES = [
    ("language_id", identified),
    ("toxicity", clean),
    ("ngram_join", distinct),
    ("line_dedup", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned filters and the tokenizer are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None
