"""Live progress: annotated frames per guid as saves arrive.

A streaming aggregate in update mode over the saves, each frame once (a re-save overwrites its
record), joined with the static number of frames per guid. A batch emits the guids it changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress_stream(saves: DataFrame, frames: DataFrame) -> DataFrame:
    """guid, n_done, n_total, progress from a stream of saves (guid, frame_num) and the static frame
    index. The state is one entry per saved frame and one count per guid."""
    totals = frames.groupBy("guid").agg(F.count(F.lit(1)).alias("n_total"))
    done = saves.dropDuplicates(["guid", "frame_num"]).groupBy("guid").agg(F.count(F.lit(1)).alias("n_done"))
    out = done.join(totals, "guid", "left").select(
        "guid", F.col("n_done").cast("long").alias("n_done"), F.coalesce("n_total", F.lit(0)).cast("long").alias("n_total"))
    return out.withColumn("progress", F.concat_ws("/", F.col("n_done").cast("string"), F.col("n_total").cast("string")))


def progress_table(updates: DataFrame, frames: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The progress of every guid from the updates written so far: the last one of a guid, guids
    without a save at zero."""
    last = updates.groupBy("guid").agg(F.max_by("n_done", batch).alias("n_done"))
    totals = frames.groupBy("guid").agg(F.count(F.lit(1)).alias("n_total"))
    out = totals.join(last, "guid", "full_outer").select(
        "guid", F.coalesce("n_done", F.lit(0)).cast("long").alias("n_done"), F.coalesce("n_total", F.lit(0)).cast("long").alias("n_total"))
    return out.withColumn("progress", F.concat_ws("/", F.col("n_done").cast("string"), F.col("n_total").cast("string")))
