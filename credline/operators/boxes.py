"""OCR boxes: confidence tiers, corner geometry, per-frame explode and frame joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credline.schemas import CONF_HIGH, CONF_MEDIUM


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def confidence_tier(conf) -> Column:
    """``high`` above 0.8, ``medium`` above 0.5, else ``low``. NaN is low (in Spark NaN
    compares greater than every number, so it is tested first)."""
    c = _c(conf)
    return (F.when(c.isNull() | F.isnan(c), F.lit("low"))
            .when(c > F.lit(CONF_HIGH), F.lit("high"))
            .when(c > F.lit(CONF_MEDIUM), F.lit("medium"))
            .otherwise(F.lit("low")))


def corners(bbox) -> dict[str, Column]:
    """Top-left (point 0) and bottom-right (point 2) corners, truncated to integers."""
    b = _c(bbox)
    return {"x0": b[0]["x"].cast("int"), "y0": b[0]["y"].cast("int"),
            "x2": b[2]["x"].cast("int"), "y2": b[2]["y"].cast("int")}


def rect_bbox(x0, y0, x1, y1) -> Column:
    """Four corner points of an axis-parallel rectangle, clockwise from top-left."""
    pt = lambda x, y: F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))
    return F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1))


def explode_boxes(df: DataFrame, boxes: str = "boxes", keys=("guid", "frame_num")) -> DataFrame:
    """One row per OCR box of a frame: keys, box_pos (display number), bbox, text,
    confidence."""
    return df.select(*keys, F.posexplode(boxes).alias("box_pos", "_b")).select(
        *keys, F.col("box_pos").cast("long"), "_b.bbox", "_b.text", "_b.confidence")


def write_boxes(boxes: DataFrame, path: str) -> None:
    """Boxes as Parquet, clustered by (guid, frame): range-partitioned, so a long video is
    spread over many files and a frame's boxes stay together."""
    (boxes.repartitionByRange("guid", "frame_num").sortWithinPartitions("guid", "frame_num")
     .write.parquet(path))


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, keys=("guid", "frame_num")) -> DataFrame:
    """``df`` as a table bucketed and sorted by (guid, frame), one file a bucket, so that tables of
    equal bucket numbers join without an exchange. The hash covers the frame too: a long guid is
    spread over all buckets. Returns the table."""
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def boxes_for_frames(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Inner equi join of frames with their boxes on (guid, frame_num)."""
    return frames.join(boxes, ["guid", "frame_num"], "inner")
