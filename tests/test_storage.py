"""Stored tables: where they lie, and that they can be deleted."""

from __future__ import annotations

import os

import pytest

from tracemill.functions import storage


def test_tables_lie_in_the_named_folder_and_can_be_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    rows = storage.stored(spark.range(10), "numbers")
    assert rows.count() == 10 and f"{tmp_path}/tracemill/{spark.sparkContext.applicationId}/numbers-" in rows.inputFiles()[0]
    assert storage.discard(spark) and os.listdir(tmp_path / "tracemill") == []
    assert not storage.discard(spark)
    with pytest.raises(Exception, match="not exist"):
        rows.collect()


def test_wide_rows_are_written_without_methods_that_stay_interpreted(spark, monkeypatch):
    """While a wide table is written Spark's limit on methods is what HotSpot compiles; the caller's setting comes back, also after an error."""
    from pyspark.sql import DataFrameWriter

    name, seen, write = "spark.sql.codegen.hugeMethodLimit", [], DataFrameWriter.parquet

    def watched(self, path):
        seen.append(int(spark.conf.get(name)))
        if "fails" in path:
            raise OSError("full")
        return write(self, path)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    before = spark.conf.get(name)
    assert storage.stored(spark.range(3), "wide", wide=True).count() == 3 and spark.conf.get(name) == before
    with pytest.raises(OSError):
        storage.stored(spark.range(3), "fails", wide=True)
    assert spark.conf.get(name) == before
    storage.stored(spark.range(3), "narrow")
    assert seen == [storage.COMPILED_METHOD, storage.COMPILED_METHOD, int(before)]


#: Spark's limit on what it broadcasts: by the files' size before a plan runs, and by what a shuffle has shown.
PLANNED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.fixture
def limits(spark):
    """Sets both limits (None: unset); they are as before when the test ends."""

    def put(planned, measured):
        for name, value in ((PLANNED, planned), (MEASURED, measured)):
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)

    before = spark.conf.get(PLANNED), spark.conf.get(MEASURED, None)
    yield put
    put(*before)


@pytest.mark.parametrize(("given", "kept"), [(("50000", None), ("-1", "50000")), (("50000", "7"), ("-1", "7")), (("-1", None), ("-1", None))])
def test_limits_of_joins_that_are_measured(spark, limits, given, kept):
    """The session's limit becomes that of measured sizes; one it has for those stays, and a session that broadcasts nothing keeps to that."""
    limits(*given)
    for _ in range(2):
        storage.measured_joins(spark)
        assert (spark.conf.get(PLANNED), spark.conf.get(MEASURED, None)) == kept


def kinds_of_joins(df):
    """The joins of the plan as it ran."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return {kind for kind in ("BroadcastHashJoin", "SortMergeJoin") if kind in ran}


def test_a_table_that_is_small_on_disk_only_is_not_broadcast(spark, limits):
    limits("200000", None)
    many = storage.stored(spark.range(50_000, numPartitions=1).selectExpr("'a session' AS s", "id DIV 100 AS k", "'a label' AS v"), "packed")
    few = storage.stored(spark.range(20).selectExpr("'a session' AS s", "id AS k"), "few")
    calls = many.selectExpr("s", "k + 0 AS k")
    assert kinds_of_joins(calls.join(many.filter("k < 200"), ["s", "k"])) == {"BroadcastHashJoin"}
    storage.measured_joins(spark)
    assert kinds_of_joins(calls.join(many.filter("k < 200"), ["s", "k"])) == {"SortMergeJoin"}
    assert kinds_of_joins(calls.join(few, ["s", "k"])) == {"BroadcastHashJoin"}
