"""Stage hop over newly arrived files.

A file-source stream with a checkpoint processes every file exactly once: re-running the
hop only picks up files that arrived since. Sub-folders are searched, hidden files and
folders (``.`` / ``_``) are skipped by the listing, and only names matching the glob are
read, so files renamed after processing are never picked up again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stage_hop(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
              checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None,
              glob: str = "*.parquet", fmt: str = "parquet", archive_dir: str | None = None,
              max_files_per_batch: int = 1000, options: dict[str, str] | None = None) -> int:
    """Run one ``availableNow`` pass of ``source_dir -> transform -> sink_dir`` and return
    the number of input rows of the pass. ``options`` go to the reader (for CSV stage files
    ``sources.tables.CSV_OPTIONS``, which keep quoted line breaks and skip the header). With
    ``archive_dir`` the file source moves every processed file there (the hand-off marks a
    file done without deleting it)."""
    reader = (spark.readStream.schema(schema).format(fmt)
              .option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", max_files_per_batch).options(**(options or {})))
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    stream = reader.load(source_dir)
    out = transform(stream) if transform else stream
    q = (out.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start(sink_dir))
    rows: dict[int, int] = {}  # Spark keeps the last 100 progress reports only, so they are read as it runs
    ended = False
    while not ended:
        ended = q.awaitTermination(0.2)
        rows.update((p["batchId"], p["numInputRows"]) for p in q.recentProgress)
    return sum(rows.values())
