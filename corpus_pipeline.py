"""Corpus pipeline: quality, near-dedup, repeated passages, decontamination, packing."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontamination, near_dedup, packing, quality, repeats
from tracemill.llm.common import BATCH_BYTES, BATCH_ROWS, bounded_batches, crc_mod, row_key, table, written
from tracemill.llm.registry import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; its labels are those of the op7 query."""
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1))
    return quality.score_quality(docs, model, keep=True).filter("score >= 0.5").select(*COLUMNS)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group, and every document that is in none.

    Shingles of five words and a similarity of 0.8, the pipeline's own setting.
    Rows are told apart by id and text: of repeated rows, of rows that share an id and of
    copies without an id one stays as well, so every text that had a group survives in one row.
    """
    return near_dedup.one_of_each(docs.select(*COLUMNS), size=5, percent=80)


#: A passage of over 50 words of prose has more bytes than this; the shortest one of check_s that two documents share has 248.
PASSAGE_BYTES, PASSAGE_GRAM, PASSAGE_WORDS = 220, 88, 51


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that occur elsewhere too; documents that nothing is left of go."""
    left = repeats.without_repeats(docs.select(*COLUMNS, F.col("text").alias("_before")), PASSAGE_BYTES, PASSAGE_GRAM, PASSAGE_WORDS)
    emptied = F.length(F.trim("text")) == 0
    cut = ~F.col("text").eqNullSafe(F.col("_before"))
    return left.filter(~F.coalesce(cut & emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Rows are told apart by a digest of id and text, so null ids and rows that
    share an id are judged each for itself.
    """
    keyed = docs.withColumn("_row", F.hex(row_key("doc_id", "text")))
    found = decontamination.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="_row")
    return keyed.join(found.filter("contaminated").select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with Arrow batches half as large: workers of several stages stay about side by side and keep what they took."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark, BATCH_ROWS // 2, BATCH_BYTES // 2)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", in_small_batches(keep_quality)),
    ("near_dedup", in_small_batches(keep_one_of_group)),
    ("repeats", in_small_batches(cut_repeats)),
    ("decontamination", in_small_batches(drop_contaminated)),
    ("packing", in_small_batches(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and a vocabulary's merges have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None
