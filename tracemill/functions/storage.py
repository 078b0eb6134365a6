"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    """A temporary folder of this process, for a single machine; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix="tracemill-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder on a single machine and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "local")
    if not named and (master.startswith("local-cluster") or not master.startswith("local")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or _own_folder()).rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """Where this application keeps its tables: a folder of its own in the shared one."""
    return f"{shared_folder(spark)}/tracemill/{spark.sparkContext.applicationId}"


#: Bytes of a method beyond which HotSpot does not compile it; Spark's own limit is what a class file can hold.
COMPILED_METHOD = 8000


@contextlib.contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Plans run in this context leave out whole-stage methods that the JVM would interpret for every row, and evaluate their expressions in parts."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), COMPILED_METHOD))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def measured_joins(spark: SparkSession) -> None:
    """From now on the session broadcasts a side of a join only after a shuffle has shown how large its rows are; hints stay as they are.

    Before it runs, Spark takes a table for as large as its files.  Sorted tables of short repeated texts are packed to about
    a byte a row, so a table of millions of rows passes for a small one, and the driver gathers all of it.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(planned)
    if not limit.startswith("-"):
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, limit)
        spark.conf.set(planned, "-1")


def stored(df: DataFrame, label: str, wide: bool = False) -> DataFrame:
    """Write and read back.

    Cuts the lineage: what follows depends on stored files, not on executors,
    and row ids drawn before the write stay what they are.  The files stay until
    ``discard`` is called, or for a folder of this process's own until it ends.
    ``wide`` is for rows that many expressions make: see ``short_methods``; their files are packed more tightly.
    """
    path = f"{application_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if wide:
        with short_methods(df.sparkSession):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> bool:
    """Delete all tables this application has stored; results that read them must have been written out before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
