"""Operators over ordered rows: request groups, running indexes, epochs, carry-forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def request_groups(lines: DataFrame, partition: Sequence[str], request: str, line: str, output: str, snapshot: Sequence[str], first: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """One row for each request: the snapshot of its most complete line.

    The whole snapshot comes from the line of greatest output, the earliest of
    equals; ``last_output`` is the rival rule's figure, ``output_varies`` tells whether
    the lines disagree, ``line_count`` how many there are, and ``first`` columns come from the
    first line; ``more`` are further aggregates of a group.  ``call_index`` numbers the groups of a partition by first line.
    One shuffle, combined before it.
    """
    rank = F.struct(F.col(output), -F.col(line))
    grouped = lines.groupBy(*partition, request).agg(
        F.max_by(F.struct(output, *[c for c in snapshot if c != output]), rank).alias("_s"),
        F.max_by(output, line).alias("last_output"),
        (F.min(output) != F.max(output)).alias("output_varies"),
        F.count(F.lit(1)).alias("line_count"),
        F.min(line).alias("first_line"),
        *[F.min_by(c, line).alias(c) for c in first],
        *more,
    )
    w = Window.partitionBy(*partition).orderBy("first_line")
    return grouped.select("*", "_s.*").drop("_s").withColumn("call_index", F.row_number().over(w) - 1)


def calls_seen(lines: DataFrame, partition: Sequence[str], line: str, request: Column) -> DataFrame:
    """Add ``next_call``: how many distinct requests came before each row (``request`` is null on other rows)."""
    first = Window.partitionBy(*partition, "_r").orderBy(line)
    before = Window.partitionBy(*partition).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("_r", request).withColumn("_new", F.when(F.col("_r").isNotNull() & (F.row_number().over(first) == 1), 1).otherwise(0))
    return marked.withColumn("next_call", F.coalesce(F.sum("_new").over(before), F.lit(0))).drop("_r", "_new")


def extents(openers: DataFrame, partition: Sequence[str], order: str, first: str, total: Column) -> DataFrame:
    """Add ``turn_index`` and ``last_call``: a row lasts until the next begins, the last one until ``total`` - 1."""
    w = Window.partitionBy(*partition).orderBy(order)
    return openers.withColumn("turn_index", F.row_number().over(w) - 1).withColumn(
        "last_call", F.coalesce(F.lead(first).over(w) - 1, F.greatest(F.lit(0), total - 1))
    )


def with_epochs(calls: DataFrame, partition: Sequence[str], order: str, read: str = "cache_read", creation: str = "cache_creation") -> DataFrame:
    """Add ``epoch`` and the prediction of ``read``.

    An epoch ends where fewer cached tokens are read than by the call before.
    Within one, a call should read what the first read and all that the calls
    between wrote.  The opening call predicts itself and is not ``predictable``.
    """
    w = Window.partitionBy(*partition).orderBy(order)
    before = Window.partitionBy(*partition, "epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    opened = Window.partitionBy(*partition, "epoch").orderBy(order)
    return (
        calls.withColumn("previous_read", F.lag(read).over(w))
        .withColumn("previous_creation", F.lag(creation).over(w))
        .withColumn("_drop", F.coalesce((F.col(read) < F.col("previous_read")).cast("int"), F.lit(0)))
        .withColumn("epoch", F.sum("_drop").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_drop")
        .withColumn("expected", F.first(read).over(opened) + F.coalesce(F.sum(creation).over(before), F.lit(0)))
        .withColumn("predictable", F.row_number().over(opened) > 1)
        .withColumn("delta", F.col(read) - F.col("expected"))
    )


def epoch_table(calls: DataFrame, partition: Sequence[str], order: str, ts: str, creation: str = "cache_creation") -> DataFrame:
    """A row for each epoch: first and last call, tokens written anew and the idle gap before it (none for the first)."""
    w = Window.partitionBy(*partition).orderBy("epoch")
    ends = calls.groupBy(*partition, "epoch").agg(
        F.min(order).alias("start_call"), F.max(order).alias("end_call"), F.min_by(creation, order).alias("_c"), F.min_by(ts, order).alias("_t0"), F.max_by(ts, order).alias("_t1")
    )
    later = F.col("epoch") > 0
    return (
        ends.withColumn("rewritten", F.when(later, F.col("_c")).otherwise(0).cast("long"))
        .withColumn("gap", F.when(later, F.col("_t0") - F.lag("_t1").over(w)).otherwise(0).cast("long"))
        .drop("_c", "_t0", "_t1")
    )


def conservation(calls: DataFrame, partition: Sequence[str], read: str = "cache_read") -> DataFrame:
    """Totals of what was read and predicted, and how many predictable calls are exact."""
    predictable = F.col("predictable")
    return calls.groupBy(*partition).agg(
        F.sum(read).alias("actual_read"),
        F.sum("expected").alias("predicted_read"),
        F.count_if(predictable & (F.col("delta") == 0)).alias("exact_calls"),
        F.count_if(predictable).alias("predictable_calls"),
    )


def carry_forward(rows: DataFrame, partition: Sequence[str], order: str, value: str, fallback: str) -> DataFrame:
    """Fill ``value`` from the last row that decided it, ``fallback`` before any did; ``carried`` tells which were filled."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(fallback))
    return rows.withColumn("carried", F.col(value).isNull() & F.last(value, ignorenulls=True).over(w).isNotNull()).withColumn(value, filled)


def stacked(rows: DataFrame, partition: Sequence[str], order: str, height: str) -> DataFrame:
    """Add ``y0`` and ``y1``: where each row's height lies when they are stacked in order."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("y1", F.sum(height).over(w)).withColumn("y0", F.col("y1") - F.col(height))


def capped_selection(rows: DataFrame, group: str, order: Sequence[Column], per_group: int, limit: int) -> DataFrame:
    """At most ``per_group`` rows of a group, then ``limit`` in all, in the given order.

    The global cut sorts and limits, so only ``limit`` rows of each partition travel.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_group).drop("_n").orderBy(*order).limit(limit)
