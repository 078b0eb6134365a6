"""Following a growing corpus: sessions that gained records are analysed and exported again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Folders that stored records are dealt into by session.
BUCKETS = 256


def bucket_of(session: str = "session_id", buckets: int = BUCKETS) -> Column:
    """The folder of a session's records, for ``partitionBy`` when they are written."""
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def follow(arriving: DataFrame, stored: Callable[[], DataFrame], export: Callable[[DataFrame, int], None], checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Export all records of each session that a micro-batch touches.

    ``arriving`` is a stream of records with ``session_id``; ``stored`` reads what is stored so far (the batch
    included); ``export`` gets the touched sessions' records and the batch's number.  Exported ids are
    digests of what they name, so a batch that is run again, or a session that has grown, replaces
    what was exported before: no state is kept and late records need no watermark.

    Where stored records are partitioned by a column ``bucket`` (see ``bucket_of``), only the folders
    of touched sessions are read; at most ``buckets`` numbers come to the driver for it.
    """

    def batch(df: DataFrame, number: int) -> None:
        touched = df.select("session_id").distinct()
        known = stored()
        if "bucket" in known.columns:
            met = [r[0] for r in touched.select(bucket_of(buckets=buckets)).distinct().collect()]
            known = known.filter(F.col("bucket").isin(met))
        export(known.join(touched, "session_id", "left_semi"), number)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
