"""Gold records as a snapshot that takes new saves bucket by bucket.

The snapshot holds the latest save of every frame, dealt over buckets of (guid, run of frames): a
guid of any length spreads over many buckets, frames next to each other stay together. A batch
of saves reads and rewrites only the buckets it touches (partition pruning, dynamic overwrite);
exports read the snapshot as it is instead of folding the whole log again.

The merged rows are written to the scratch folder before the snapshot is touched. If a batch
breaks off while its buckets are replaced, applying it (and, where no copy of the log is kept, the
batches since the last backup) again gives the same snapshot: of the saves of a frame the one with
the largest ``seq`` wins, however often and in whatever order they come.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credline.operators.common import materialize
from credline.operators.frames import last_write

SNAPSHOT = ("guid string, frame_num long, seq long, bindings map<string,array<string>>, meta map<string,string>, bucket int")
FRAMES_A_RUN = 1000
BUCKETS = 256


def bucket(buckets: int = BUCKETS, frames_a_run: int = FRAMES_A_RUN) -> Column:
    return F.pmod(F.xxhash64("guid", F.floor(F.col("frame_num") / frames_a_run)), F.lit(buckets)).cast("int")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The latest save of every frame (empty before the first batch)."""
    try:
        return spark.read.schema(SNAPSHOT).parquet(path)
    except AnalysisException:  # no such folder yet
        return spark.createDataFrame([], SNAPSHOT)


def upsert(records: DataFrame, path: str, buckets: int = BUCKETS, frames_a_run: int = FRAMES_A_RUN) -> list[int]:
    """Merge saves (guid, frame_num, seq, bindings, meta) into the snapshot. Returns the buckets that
    were rewritten; a batch of nothing but older saves rewrites none. ``buckets`` and ``frames_a_run``
    stay the same for the life of a snapshot."""
    spark, cols = records.sparkSession, ["guid", "frame_num", "seq", "bindings", "meta"]
    new = last_write(records, ["guid", "frame_num"], "seq", ["bindings", "meta"]).select(*cols)
    new = materialize(new.withColumn("bucket", bucket(buckets, frames_a_run)), "saves")
    near = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    old = read_snapshot(spark, path).filter(F.col("bucket").isin(near))
    newer = (new.join(old.select("guid", "frame_num", F.col("seq").alias("_old")), ["guid", "frame_num"], "left")
             .filter(F.col("_old").isNull() | (F.col("seq") > F.col("_old"))))
    touched = sorted(r["bucket"] for r in newer.select("bucket").distinct().collect())
    if touched:
        both = old.unionByName(new).filter(F.col("bucket").isin(touched))
        merged = last_write(both, ["guid", "frame_num"], "seq", ["bindings", "meta", "bucket"])
        merged = materialize(merged.select(*cols, "bucket"), "merged")
        (merged.repartition("bucket").sortWithinPartitions("bucket", "guid", "frame_num").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    return touched


def gold_rows(snapshot: DataFrame) -> DataFrame:
    """The snapshot as gold annotations (``schemas.GOLD_ROW``)."""
    meta = F.col("meta")
    return snapshot.select("guid", "frame_num", "bindings", meta["_image_id"].alias("image_id"),
                           meta["_continued_from"].alias("continued_from"), meta["_skip_reason"].alias("skip_reason"))
