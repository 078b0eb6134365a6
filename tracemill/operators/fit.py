"""Per-model tokenizer fits: non-negative least squares from five moment sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewest points that a fit rests on.
MIN_POINTS = 32


def moments(when: Column, prefix: str) -> list[Column]:
    x, b, y = (F.when(when, F.col(c).cast("double")) for c in ("chars", "blocks", "output"))
    pairs = {"cc": x * x, "bb": b * b, "cb": x * b, "cy": x * y, "by": b * y, "c": x, "b": b, "y": y}
    return [F.coalesce(F.sum(v), F.lit(0.0)).alias(prefix + k) for k, v in pairs.items()] + [F.count_if(when).alias(prefix + "n")]


def coefficients(p: str) -> tuple[Column, Column]:
    """a and b of output = a * chars + b * blocks, neither negative.

    Where the free solution has a negative one, the better of the two axes is
    taken; the sum of squared outputs is common to both and drops out.
    """
    cc, bb, cb, cy, by = (F.col(p + k) for k in ("cc", "bb", "cb", "cy", "by"))
    det = cc * bb - cb * cb
    a, b = F.try_divide(cy * bb - by * cb, det), F.try_divide(by * cc - cy * cb, det)
    free = (det > 0) & (a >= 0) & (b >= 0)
    a1, b1 = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(cy, cc), F.lit(0.0))), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(by, bb), F.lit(0.0)))
    chars_better = a1 * a1 * cc - 2 * a1 * cy <= b1 * b1 * bb - 2 * b1 * by
    return F.when(free, a).when(chars_better, a1).otherwise(0.0), F.when(free, b).when(chars_better, 0.0).otherwise(b1)


def fit_tokenizers(points: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """``model``, ``chars_per_token``, ``tokens_per_block``, ``points``, ``transcripts`` and ``held_out_error``.

    ``points`` has ``model``, ``transcript``, ``chars``, ``blocks`` and ``output``.  A model's transcripts alternate, in
    order, between training and test for the held-out error; the fit itself
    takes all points.  Models with too few points, one transcript or no
    positive rate get no row.  Moments are summed before the shuffle.
    """
    w = Window.partitionBy("model").orderBy("transcript")
    even = points.select("model", "transcript").distinct().withColumn("train", F.row_number().over(w) % 2 == 1)
    sums = (
        points.join(even, ["model", "transcript"])
        .groupBy("model")
        .agg(*moments(F.lit(True), "all_"), *moments(F.col("train"), "train_"), *moments(~F.col("train"), "test_"), F.count_distinct("transcript").alias("transcripts"))
    )
    (a, b), (ta, tb) = coefficients("all_"), coefficients("train_")
    fitted = sums.withColumn("a", a).withColumn("b", b).withColumn("ta", ta).withColumn("tb", tb)
    error = F.coalesce(F.try_divide(F.col("ta") * F.col("test_c") + F.col("tb") * F.col("test_b") - F.col("test_y"), F.col("test_y")), F.lit(0.0))
    return fitted.filter((F.col("all_n") >= min_points) & (F.col("a") > 0) & (F.col("train_n") > 0) & (F.col("test_n") > 0)).select(
        "model", (1 / F.col("a")).alias("chars_per_token"), F.col("b").alias("tokens_per_block"), F.col("all_n").alias("points"), "transcripts", error.alias("held_out_error")
    )


def split_output(calls: DataFrame, tokenizers: DataFrame) -> DataFrame:
    """Add ``visible``, ``remainder`` and ``split`` (reasoning, estimator-error or uncalibrated); the remainder may be negative.

    ``calls`` has ``model``, ``chars``, ``blocks``, ``reasoned`` and ``output``.
    """
    visible = F.floor(F.col("chars") / F.col("chars_per_token") + F.col("blocks") * F.col("tokens_per_block") + F.lit(0.5))
    known = F.col("chars_per_token").isNotNull()
    return (
        calls.join(tokenizers.select("model", "chars_per_token", "tokens_per_block"), "model", "left")
        .withColumn("visible", F.when(known, visible).cast("long"))
        .withColumn("remainder", F.when(known, F.col("output") - F.col("visible")).otherwise(F.col("output")).cast("long"))
        .withColumn("split", F.when(~known, "uncalibrated").when(F.col("reasoned"), "reasoning").otherwise("estimator-error"))
        .drop("chars_per_token", "tokens_per_block")
    )


def output_totals(split: DataFrame, scope: list[str]) -> DataFrame:
    """The four parts that close on the total, with calls and the models that have no fit."""
    part = lambda k: F.coalesce(F.sum(F.when(F.col("split") == k, F.col("remainder"))), F.lit(0))
    return split.groupBy(*scope).agg(
        F.sum("output").alias("total"), F.coalesce(F.sum("visible"), F.lit(0)).alias("visible"), part("reasoning").alias("reasoning"),
        part("estimator-error").alias("estimator_error"), part("uncalibrated").alias("uncalibrated"),
        F.count_if(F.col("split") == "reasoning").alias("calls_with_reasoning"), F.count_if(F.col("split") == "uncalibrated").alias("uncalibrated_calls"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("split") == "uncalibrated", F.col("model")))), ",").alias("uncalibrated_models"),
        F.count(F.lit(1)).alias("calls"),
    )
