"""The driver's tables seen as session traces, so that the operators run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> F.Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))") / 1000).cast("long")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as API calls of their user's conversation, in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        F.col("event_type").alias("model"),
        millis("ts").alias("ts_ms"),
        (F.row_number().over(w) - 1).cast("long").alias("call_index"),
        F.floor(F.col("value") * 10).cast("long").alias("cache_read"),
        (F.col("event_id") % 97).alias("cache_creation"),
        (F.col("event_id") % 13).alias("input"),
        (F.col("event_id") % 251).alias("output"),
    )


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows with ``next_call``: assistant rows are calls, user rows open turns."""
    from tracemill.operators.sequence import calls_seen

    rows = table(spark, sf_dir, "conversations")
    return calls_seen(rows, ["conv_id"], "turn", F.when(F.col("role") == "assistant", F.col("turn")))


def part_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a forest: the parent of part n is part n div 4; where that is 7, 57, 107 and so on the part names a parent that is none and is an orphan."""
    up = F.floor(F.col("p_partkey") / 4).cast("long")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") > 0, F.when(up % 50 == 7, -up).otherwise(up)).alias("parent"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").cast("long").alias("own"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as calibration points; twenty documents have a model of their own, which has too few at every size."""
    words = F.size(F.split("text", " ")).cast("long")
    y = F.floor(F.col("n_chars") / 3).cast("long") + 5 * words + F.col("doc_id") % 11
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.when(F.col("doc_id") < 20, "rare").otherwise(F.col("lang")).alias("model"), F.col("source").alias("transcript"), F.col("n_chars").alias("chars"), words.alias("blocks"), y.alias("output"))
    )
