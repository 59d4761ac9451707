"""Queries over the corpus tables by name, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geoweft.llm import avi, bitsliced, byte_bpe, decontaminate, divergence, language_id, licenses, line_dedup, ngram_join, packing, prefix_trie, suffix_dedup, toxicity
from geoweft.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op2_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.nearest(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_avi": op2_avi,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_top_k": op4_top_k,
    "op5_packing": op5_packing,
    "op6_ngram_join": op6_ngram_join,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_decontaminate": op13_decontaminate,
}

ORACLES: dict[str, str] = {"op4_top_k": bitsliced.SQL, "op8_line_dedup": line_dedup.SQL, "op9_license_scan": licenses.sql(), "op11_source_divergence": divergence.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_decontaminate": decontaminate.SQL}
