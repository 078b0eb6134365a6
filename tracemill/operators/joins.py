"""Joins: answers to requests, as-of, lifetimes over intervals, dated rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.tokens import READ, WRITE


def last_wins(rows: DataFrame, key: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One row for each key with the last row's values; ``slot`` is where the key first stood, ``repeats`` how many rows were replaced."""
    return (
        rows.groupBy(*key)
        .agg(F.max_by(F.struct(*values), order).alias("_v"), F.min(order).alias("slot"), (F.count(F.lit(1)) - 1).alias("repeats"))
        .select(*key, "_v.*", "slot", "repeats")
    )


def answered(requests: DataFrame, answers: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every request with its one answer; without one the answer's columns are null."""
    return requests.join(answers, [*key], "left")


def unmatched(answers: DataFrame, requests: DataFrame, key: Sequence[str]) -> DataFrame:
    """Answers to nothing that was requested."""
    return answers.join(requests.select(*key).distinct(), [*key], "left_anti")


def duplicate_answers(answers: DataFrame, requests: DataFrame, key: Sequence[str]) -> DataFrame:
    """For each requested key with several answers, how many there are beyond the first."""
    met = answers.join(requests.select(*key).distinct(), [*key], "left_semi")
    return met.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("duplicates")).filter("duplicates > 0")


def as_of(left: DataFrame, right: DataFrame, partition: Sequence[str], left_ts: str, right_ts: str, value: str, default: object = None) -> DataFrame:
    """``left`` with the ``value`` of the last ``right`` row at or before its time, else ``default``.

    Both sides are united and read in order once: no join, one shuffle, and
    no blow-up however many rows of a key lie close in time.  Of right rows at
    one time the greatest value counts.
    """
    lcols = [c for c in left.columns if c not in partition]
    l = left.select(*partition, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))  # noqa: E741
    r = right.select(*partition, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"))
    w = Window.partitionBy(*partition).orderBy("_t", "_side", F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("_v", ignorenulls=True).over(w), F.lit(default).cast(right.schema[value].dataType))
    return l.unionByName(r).withColumn("_f", found).filter("_side = 1").select(*partition, "_l.*", F.col("_f").alias(value))


def lifetimes(arrivals: DataFrame, epochs: DataFrame, partition: Sequence[str], born: str, tokens: str) -> DataFrame:
    """What each arrival costs over all epochs it lives through.

    It is written once in every epoch that ends at or after its birth and read
    by every later call of that epoch.  Epochs are disjoint and in order, so
    sums from the last one back give all later epochs' share, and an arrival
    only meets the epoch it is born in.  Adds ``writes``, ``reads``, ``total`` and ``multiple``.
    """
    after = Window.partitionBy(*partition).orderBy("epoch").rowsBetween(1, Window.unboundedFollowing)
    sums = epochs.select(
        *partition,
        "start_call",
        "end_call",
        F.coalesce(F.count(F.lit(1)).over(after), F.lit(0)).alias("_later"),
        F.coalesce(F.sum(F.col("end_call") - F.col("start_call")).over(after), F.lit(0)).alias("_later_reads"),
        F.coalesce(F.lag("end_call").over(Window.partitionBy(*partition).orderBy("epoch")), F.lit(-1)).alias("_from"),
    )
    at = (F.col(born) > F.col("_from")) & (F.col(born) <= F.col("end_call"))
    joined = arrivals.alias("a").join(sums.alias("e"), [*[F.col(f"a.{c}").eqNullSafe(F.col(f"e.{c}")) for c in partition], at], "left")
    lives = F.col("end_call").isNotNull()
    writes = F.when(lives, F.col("_later") + 1).otherwise(0)
    reads = F.when(lives, F.col("_later_reads") + F.col("end_call") - F.greatest(F.col("start_call"), F.col(born))).otherwise(0)
    out = joined.select("a.*", writes.cast("long").alias("writes"), reads.cast("long").alias("reads"))
    total = F.col(tokens) * (F.col("writes") * F.lit(WRITE) + F.col("reads") * F.lit(READ))
    return out.withColumn("total", total).withColumn("multiple", F.coalesce(F.try_divide("total", F.col(tokens).cast("double")), F.lit(0.0)))


def at_rates(items: DataFrame, rates: DataFrame, model: Column, ts: str) -> DataFrame:
    """``items`` with the rate in force at their instant, null where there is none.

    ``rates`` has ``model``, ``valid_from``, ``valid_to`` (exclusive, null: open), ``in_rate`` and ``out_rate``; a
    rate card is a short list, and Spark broadcasts it if its size allows.
    """
    card = rates.select(F.col("model").alias("_model"), "valid_from", "valid_to", "in_rate", "out_rate")
    held = (F.col(ts) >= F.coalesce(F.col("valid_from"), F.lit(-(1 << 62)))) & (F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to")))
    return items.withColumn("_m", model).join(card, (F.col("_m") == F.col("_model")) & held, "left").drop("_model", "valid_from", "valid_to").withColumnRenamed("_m", "rated_model")


def within(calls: DataFrame, turns: DataFrame, partition: Sequence[str], index: str) -> DataFrame:
    """Each call with its turn's index, null before the first: turns follow each other without gaps, so this is an as-of join."""
    lasting = turns.filter("last_call >= first_call")
    return as_of(calls, lasting, partition, index, "first_call", "turn_index")
