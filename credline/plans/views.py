"""Adapter views: the driver's tables recast as annotation data.

Each view has a Spark form (here) and a SQL form (``oracle.VIEW_SQL``) that compute the
same rows. Views read whole tables; column pruning and filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credline.functions.text import tokens
from credline.schemas import GUID_PREFIX, REASON_DUPLICATE


SPREAD = "credline.spread"  # session setting: number of partitions for texts, unset by default


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts. A table written as one row group is one task, whatever follows; a caller who has
    such tables sets ``credline.spread`` to a number of partitions, and the pruned columns are dealt
    by id before any work on the texts. It is the caller's choice alone: no size is looked at."""
    docs = table(spark, sf_dir, "documents")
    spread = spark.conf.get(SPREAD, None)
    return docs.repartition(int(spread), "doc_id") if spread else docs


def v_ocr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2/E4 rows: one OCR text per document, review flags from ``labels``."""
    d = documents(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(
        "doc_id", F.lit(True).alias("_lab"), "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit(GUID_PREFIX), F.col("source")).alias("guid"),
        (F.col("doc_id") * 1000).alias("time_point"),
        F.when(F.col("lang") == "en", "I").when(F.col("lang") == "fr", "N")
         .when(F.col("lang") == "es", "C").otherwise("S").alias("scene_code"),
        ((F.col("n_chars") % 101).cast("double") / 100.0).alias("confidence"),
        F.col("text").alias("textdocument"),
        F.col("_lab").isNotNull().alias("annotated"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("ocr_accepted"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("deleted"),
    )


def v_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9/E10 frames: F = annotated, P = skipped (as duplicate, or for another reason), O =
    not yet annotated."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit(GUID_PREFIX), F.col("o_custkey").cast("string")).alias("guid"),
        F.col("o_orderkey").alias("frame_num"),
        F.col("o_orderpriority").alias("role"),
        (F.col("o_orderstatus") != "O").alias("annotated"),
        F.when(F.col("o_orderstatus") == "P",
               F.when(F.col("o_orderkey") % 3 == 0, "no text in image").otherwise(REASON_DUPLICATE)).alias("skip_reason"),
    )


def v_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12 time frames (some empty)."""
    o = table(spark, sf_dir, "orders")
    start = (F.col("o_orderkey") * 10) % 900
    return o.select(
        F.concat(F.lit(GUID_PREFIX), F.col("o_custkey").cast("string")).alias("guid"),
        F.col("o_orderkey").alias("tf_id"), start.alias("start_frame"),
        (start + F.col("o_custkey") % 60).alias("end_frame"))


def v_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11 OCR boxes; a zero discount gives a NaN confidence."""
    li = table(spark, sf_dir, "lineitem")
    y0 = F.col("l_tax") * 100.0
    return li.select(
        F.col("l_orderkey").alias("guid"),
        F.col("l_linenumber").cast("long").alias("frame_num"),
        F.col("l_partkey").alias("box_idx"),
        F.when(F.col("l_discount") == 0, F.lit(float("nan")))
         .otherwise(F.col("l_quantity") / 50.0).alias("confidence"),
        (F.col("l_extendedprice") / 100.0).alias("x0"),
        (F.col("l_extendedprice") / 50.0).alias("x1"),
        y0.alias("y0"), (y0 + F.col("l_quantity")).alias("y1"),
    )


def v_path_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 path rows; guids src15..src19 have none, a larger file_ord overrides."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.concat(F.lit(GUID_PREFIX + "src"), (F.col("page_id") % 15).cast("string")).alias("guid"),
        F.col("page_id").alias("file_ord"), F.col("url").alias("path"))


_ACTION = {"click": "swap", "error": "reject", "purchase": "delete", "signup": "submit"}
_ADJ_ACTION = {"signup": "accept", "error": "reject", "click": "edit", "view": "undo"}


def _case(col: str, mapping: dict, default):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(col) == k, F.lit(v)) if expr is None
                else expr.when(F.col(col) == k, F.lit(v)))
    return expr.otherwise(F.lit(default))


def v_review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13 review log."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("row_id"), F.col("event_id").alias("seq"), "ts",
                    _case("event_type", _ACTION, "undo").alias("action"))


def v_adjudication_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    action = _case("event_type", _ADJ_ACTION, "other")
    text = F.concat(F.lit("edited@BR:1 text@BF:1 "), F.col("event_id").cast("string"), F.lit("@O"))
    return e.select(F.col("user_id").alias("row_id"), F.col("event_id").alias("seq"), "ts", action.alias("action"),
                    F.when((action == "edit") & (F.col("event_id") % 4 != 0), text).alias("payload"))


def v_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    sid = F.col("doc_id").cast("string")
    return d.select(
        "doc_id",
        F.concat(F.lit("v_"), F.col("source")).alias("view_id"),
        F.concat(F.when(F.col("doc_id") % 5 == 0, "bb_").otherwise("tp_"), sid).alias("source_id"),
        F.concat(F.when(F.col("doc_id") % 7 == 0, "tok_").otherwise("td_"), sid).alias("target_id"))


def v_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("guid"), F.col("turn").alias("frame_num"), "role",
                    F.col("text").alias("filler"), (F.col("role") == "assistant").alias("continuing"))


def _tag_for(pos, doc_id):
    idx = (F.floor(pos / 6) + 1).cast("string")
    m = pos % 6
    prefix = (F.when(m == 0, "BR:").when(m == 1, "IR:").when(m == 2, "BF:")
              .when(m == 3, "IF:").otherwise("BF:"))
    return (F.when((doc_id % 17 == 0) & (pos == 3), F.lit("IF:9"))
            .when(m == 5, F.lit("O")).otherwise(F.concat(prefix, idx)))


def v_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged rows over whole documents: token i gets BR, IR, BF, IF, BF, O by i % 6 with
    index i // 6 + 1. Faults: doc_id % 17 = 0 tags token 3 ``IF:9`` (unparsable),
    doc_id % 13 = 0 loses token 5 from the tagged text (not verbatim)."""
    d = documents(spark, sf_dir)
    toks = tokens("text")
    doc = F.col("doc_id")
    tagged = F.transform(toks, lambda t, i: F.concat(t, F.lit("@"), _tag_for(i, doc)))
    kept = F.filter(tagged, lambda x, i: ~((doc % 13 == 0) & (i == 5)))
    return d.select("doc_id", F.array_join(toks, " ").alias("cleaned_text"),
                    F.array_join(kept, " ").alias("tagged"))
