"""Running sums over rows in order, however many rows one group holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.storage import stored

#: Rows that one task puts in order, about.
ROWS_IN_ORDER = 200_000


def running_sum(rows: DataFrame, value: Column, order: Sequence[Column | str], keys: Sequence[str] = (), name: str = "before") -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``keys`` that come earlier in ``order``, 0 for the first.

    A prefix scan in two steps.  Rows are dealt into ranges of (``keys``, ``order``) whose
    bounds Spark samples; each range sums its own rows, and the ranges' totals give every
    range what came before it.  Only groups that lie in several ranges need such an
    offset, at most two for each range, so the offsets are broadcast.  ``order`` must tell
    rows of a group apart; null keys form a group like any other.  ``rows`` should be
    stored, as they are read twice.
    """
    rows = rows.withColumn("_v", F.coalesce(value, F.lit(0)))
    ranges = -(-rows.count() // ROWS_IN_ORDER)
    earlier = lambda w: F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if ranges <= 1:
        return rows.withColumn(name, earlier(Window.partitionBy(*keys).orderBy(*order))).drop("_v")
    dealt = stored(rows.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = dealt.withColumn("_own", earlier(Window.partitionBy(*keys, "_range").orderBy(*order)))
    totals = dealt.groupBy(*keys, "_range").agg(F.sum("_v").alias("_v"))
    group = Window.partitionBy(*keys)
    offsets = totals.select(*keys, "_range", F.count(F.lit(1)).over(group).alias("_n"), earlier(group.orderBy("_range")).alias("_offset"))
    offsets = offsets.filter((F.col("_n") > 1) & (F.col("_offset") != 0)).select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_key"), "_offset")
    same = F.col("_range") == F.col("_key")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = within.join(F.broadcast(offsets), same, "left").withColumn(name, F.col("_own") + F.coalesce("_offset", F.lit(0)))
    return out.drop("_v", "_own", "_range", "_key", "_offset", *[f"_key_{k}" for k in keys])
