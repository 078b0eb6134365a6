"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, decontamination, divergence, language_id, licenses, near_dedup, nearest, packing, quality, repeats, spelling, token_counts, toxicity
from tracemill.llm.common import table
from tracemill.llm.sql import SQL as _SQL


def tokenizer_file(name: str) -> str:
    """Place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2_decontamination, with the windows whose words stand together in any order."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=3)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_identify(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), slips=97)
    return spelling.variant_groups(words)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op2_proximity": op2_proximity,
    "op3_packing": op3_packing,
    "op4_nearest": op4_nearest,
    "op5_near_dedup": op5_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_toxicity": op9_toxicity,
    "op10_repeats": op10_repeats,
    "op11_spelling": op11_spelling,
    "op12_bpe": op12_bpe,
    "op13_divergence": op13_divergence,
}

#: A vocabulary's merges, models and alignments have no SQL form; those queries are tested against brute force.
SQL: dict[str, str] = _SQL
