"""Ledgers: spend by a key with shares of the whole, unpivots, coverage, price totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.storage import stored
from tracemill.operators.scan import running_sum


def share_of(total: Column, whole: Column) -> Column:
    """0 where there is nothing to share."""
    return F.coalesce(F.try_divide(total.cast("double"), whole.cast("double")), F.lit(0.0))


def ledger(calls: DataFrame, key: Column, amount: Column, scope: Sequence[str] = (), flag: Column | None = None) -> DataFrame:
    """``key``, ``amount``, ``calls`` and ``share`` of the scope's total; with ``flag`` also the flagged part of the bucket.

    The whole is summed over the buckets, not over the calls again; without a scope
    it is one row that meets them where they are.
    """
    flagged = [F.sum(F.when(flag, amount).otherwise(0)).alias("flagged")] if flag is not None else []
    sums = calls.groupBy(*scope, key.alias("key")).agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("calls"), *flagged)
    if scope:
        out = sums.withColumn("share", share_of(F.col("amount"), F.sum("amount").over(Window.partitionBy(*scope))))
    else:
        whole = sums.agg(F.sum("amount").alias("_whole"))
        out = sums.join(F.broadcast(whole), how="cross").withColumn("share", share_of(F.col("amount"), F.col("_whole"))).drop("_whole")
    return out.withColumn("flagged_share", share_of(F.col("flagged"), F.col("amount"))) if flagged else out


def even_split(rows: DataFrame, owner: Sequence[str], key: str, amount: str) -> DataFrame:
    """Split each owner's amount evenly over its rows and sum by ``key``; owners without rows add nothing."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*owner))
    return rows.withColumn("_part", F.col(amount) / n).groupBy(key).agg(F.sum("_part").alias("amount"), F.count(F.lit(1)).alias("uses"))


def unpivot(totals: DataFrame, scope: Sequence[str], parts: Sequence[tuple[str, Column]]) -> DataFrame:
    """A row (``key``, ``amount``) for each named part of each row of totals."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("amount")) for k, v in parts])
    return totals.select(*scope, F.explode(entries).alias("e")).select(*scope, "e.*")


def coverage(calls: DataFrame, scope: Sequence[str], tier: str, tiers: Sequence[str], amount: Column, unclassified: Column) -> DataFrame:
    """Share of the spend that each tier labels, and the unclassified share."""
    whole = F.sum(amount)
    return calls.groupBy(*scope).agg(
        whole.alias("total"),
        *[share_of(F.sum(F.when(F.col(tier) == t, amount).otherwise(0)), whole).alias(f"tier_{t}") for t in tiers],
        share_of(F.sum(F.when(unclassified, amount).otherwise(0)), whole).alias("unclassified"),
    )


def weighted_mean(rows: DataFrame, value: str, weight: str, empty: float) -> DataFrame:
    return rows.agg(F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), F.lit(empty)).alias("mean"))


def price_totals(rated: DataFrame, scope: Sequence[str], usd: Column, amount: Column) -> DataFrame:
    """Dollars with what they leave out: spend, calls and models without a rate."""
    none = F.col("in_rate").isNull()
    return rated.groupBy(*scope).agg(
        F.coalesce(F.sum(F.when(~none, usd)), F.lit(0.0)).alias("usd"),
        F.sum(F.when(~none, amount).otherwise(0)).alias("priced"),
        F.sum(F.when(none, amount).otherwise(0)).alias("unpriced"),
        F.count_if(none).alias("unpriced_calls"),
        F.count(F.lit(1)).alias("calls"),
        F.array_join(F.array_sort(F.collect_set(F.when(none, F.col("rated_model")))), ",").alias("unpriced_models"),
    )


def dominant(rows: DataFrame, scope: Sequence[str], name: str, amount: str) -> DataFrame:
    """The name with the largest sum in each scope (the first of equals) and its share; ``unattributed`` where all is zero."""
    sums = rows.groupBy(*scope, name).agg(F.sum(amount).alias("_a"))
    top = sums.groupBy(*scope).agg(F.min_by(F.struct(name, "_a"), F.struct(-F.col("_a"), F.col(name))).alias("_t"), F.sum("_a").alias("_w"))
    some = F.col("_w") > 0
    return top.select(
        *scope, F.when(some, F.col(f"_t.{name}")).otherwise("unattributed").alias("source"), F.when(some, share_of(F.col("_t._a"), F.col("_w"))).otherwise(0.0).alias("share")
    )


def excluded_counts(rows: DataFrame, filters: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all filters, and how many each filter excluded of those that came to it."""
    passed, counts = F.lit(True), []
    for name, keep in filters:
        kept = F.coalesce(keep, F.lit(False))
        counts.append(F.count_if(passed & ~kept).alias(name))
        passed = passed & kept
    return rows.filter(passed), rows.agg(*counts, F.count_if(passed).alias("kept"))


def placed_by(rows: DataFrame, amount: str, tie: str) -> DataFrame:
    """Add ``place`` (from 1, largest ``amount`` first, nulls last, ties to the smaller ``tie``).

    Rows are dealt into ranges by sampled quantiles, so no task orders all rows and
    none has more than its share, however uneven the amounts are.
    """
    return running_sum(stored(rows, "placed"), F.lit(1), [F.desc(amount), tie], name="place").withColumn("place", (F.col("place") + 1).cast("long"))
