"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.storage import stored as written

__all__ = ["bounded_batches", "crc_mod", "hot_join", "row_key", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null ids count as '')."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def row_key(id_col: str, text_col: str) -> Column:
    """A 128-bit row id that a second reading finds again; rows alike in id and text share it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(text(id_col), F.lit("\0"), text(text_col)).cast("binary")))


#: Most rows and bytes of an Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def bounded_batches(spark: SparkSession, most_rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> None:
    """Lower the session's Arrow batches to these bounds; a smaller setting of the session's own stays.

    Executors and Python workers hold a batch several times over, and a batch of
    ten thousand texts has no bounded size.  Results do not depend on it.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= most_rows:
        spark.conf.set(rows, most_rows)
        spark.conf.set(size, most_bytes)


#: A key that holds more than this share of all rows is joined by broadcast; there are fewer such keys than its inverse.
HOT_SHARE = 1 / 1000
#: Keys of fewer rows are never hot.
HOT_ROWS = 1000


def hot_join(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, spread: int = 0) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, which has one row for each key and its number of ``rows`` in ``weight``.

    Of keys with over a thousandth of all the rows there are fewer than a
    thousand, so these are broadcast and their rows stay where they are; only
    the other keys' rows are shuffled.  Where a row of ``keys`` has no bounded size,
    ``spread`` > 0 sends that many copies of a hot key's row to as many shares of its ``rows`` instead.
    ``keys`` should be stored, as it is read three times.
    """
    total, most = keys.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    bound = max(HOT_ROWS, int(total * HOT_SHARE))
    if most <= bound:
        return rows.join(keys, on)
    hot = F.col(weight) > bound
    few = F.broadcast(keys.filter(hot).select(*on))
    rest = rows.join(few, on, "left_anti").join(keys.filter(~hot), on)
    if not spread:
        return rows.join(F.broadcast(keys.filter(hot)), on).unionByName(rest)
    dealt = rows.join(few, on, "left_semi").withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.lit(spread)))
    copies = keys.filter(hot).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    return dealt.join(copies, [*on, "_share"]).drop("_share").unionByName(rest)
