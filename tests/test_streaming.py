"""A grown session is exported again, whole, under the ids it had."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tracemill.functions import tokens as T
from tracemill.streaming.reexport import bucket_of, follow


def test_follow(spark, tmp_path):
    path, seen = str(tmp_path / "records"), []
    schema = "session_id string, line_no long"

    def export(df, number):
        seen.append({(r["session_id"], r["n"], r["id"]) for r in df.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).withColumn("id", T.trace_id(F.col("session_id"))).collect()})

    def run():
        stream = spark.readStream.schema(schema).parquet(path)
        q = follow(stream, lambda: spark.read.schema(schema).parquet(path), export, str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        assert q.exception() is None

    spark.createDataFrame([("a", 0), ("b", 0)], schema).coalesce(1).write.mode("append").parquet(path)
    run()
    spark.createDataFrame([("a", 1)], schema).coalesce(1).write.mode("append").parquet(path)
    run()
    assert [{(s, n) for s, n, _ in x} for x in seen] == [{("a", 1), ("b", 1)}, {("a", 2)}]
    assert {i for s, _, i in seen[0] if s == "a"} == {i for _, _, i in seen[1]}


def test_only_the_folders_of_touched_sessions_are_read(spark, tmp_path):
    path, read = str(tmp_path / "records"), []
    schema = "session_id string, line_no long, bucket int"

    def export(df, number):
        plan = df._jdf.queryExecution().executedPlan().toString()
        read.append((re.search(r"PartitionFilters: \[[^\]]*bucket", plan) is not None, sorted((r["session_id"], r["line_no"]) for r in df.collect())))

    def add(rows):
        df = spark.createDataFrame(rows, "session_id string, line_no long").withColumn("bucket", bucket_of(buckets=8))
        df.coalesce(1).write.mode("append").partitionBy("bucket").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        q = follow(stream, lambda: spark.read.schema(schema).parquet(path), export, str(tmp_path / "checkpoint"), buckets=8)
        q.awaitTermination(120)
        assert q.exception() is None

    add([(f"s{i}", 0) for i in range(30)])
    add([("s3", 1)])
    assert [pruned for pruned, _ in read] == [True, True] and len(read[0][1]) == 30
    assert read[1][1] == [("s3", 0), ("s3", 1)]
