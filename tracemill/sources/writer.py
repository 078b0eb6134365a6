"""Writing transcripts: lines into the files that the reader expects."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.storage import stored
from tracemill.sources.transcripts import Packed, path_columns


def write_files(lines: DataFrame, root: str) -> None:
    """Write ``value`` of each row as a line of the file ``path`` below ``root``, in order of ``place``.

    ``root`` is a folder of any file system that Arrow knows, shared by all
    executors.  Rows are dealt by file and sorted, and each task writes the files it holds one after
    another from a stream of rows, so no file is held in memory; a task that is tried again writes them anew.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        now, out, files = None, None, 0
        for batch in batches:
            for path, value in zip(batch["path"], batch["value"]):
                if path != now:
                    if out is not None:
                        out.close()
                    system.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                    now, out = path, system.open_output_stream(f"{base}/{path}")
                    files += 1
                out.write(value.encode() + b"\n")
        if out is not None:
            out.close()
        yield pd.DataFrame({"files": [files]})

    dealt = lines.select("path", "place", "value").repartition("path").sortWithinPartitions("path", "place")
    dealt.mapInPandas(write, "files long").agg({"files": "sum"}).collect()


def pack_files(lines: DataFrame, value: Column | None = None) -> Packed:
    """The corpus that ``write_files`` writes, as stored tables: very many small files would take longer to list and to open than to read.

    With ``value`` rows are dealt and put in order as they are, and the text of each is made of its columns
    afterwards, so that short rows travel in place of long lines.
    """
    numbered = lines.withColumn("line_no", (F.row_number().over(Window.partitionBy("path").orderBy("place")) - 1).cast("long"))
    texts = numbered.select(*path_columns(F.col("path")), "path", "line_no", (F.col("value") if value is None else value).alias("value"))
    held = stored(texts.withColumn("bytes", (F.octet_length("value") + 1).cast("long")), "lines", wide=True)
    files = held.groupBy("project", "session_id", "conv_id", "half", "path").agg(F.sum("bytes").alias("bytes")).withColumn("mtime", F.current_timestamp())
    return Packed(stored(files, "packed-files"), held.drop("bytes"))
