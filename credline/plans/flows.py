"""Composite flows that chain the operators the way the annotation workflow runs:
build a batch, review it, tag it, adjudicate it, and prepare frames for gold annotation.
Intermediates that several steps reuse are written once to the shared checkpoint folder, by
jobs that run while a flow is being set up; ``session.scratch_run`` deletes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credline.functions.text import verbatim_ok
from credline.operators import batch, bio, frames, review
from credline.operators.apply import annotate
from credline.operators.boxes import boxes_for_frames
from credline.operators.common import global_index
from credline.sources import annotation_json as AJ


def build_batch(spark: SparkSession, json_dir: str, one_per_file: bool = True,
                dedupe: bool = False) -> DataFrame:
    """Annotation JSON folder -> flat labelled OCR rows with a stable ``row_id`` (source
    order: file, view, annotation), near-duplicates removed first when ``dedupe``, then
    exact duplicates of the text (the earliest row is kept)."""
    anns = AJ.materialize_annotations(spark, AJ.read_annotation_docs(spark, json_dir, one_per_file))
    # the index reads rows that it has written once, so nothing above it need be written again
    rows = global_index(AJ.ocr_rows(anns), ["file", "view_ord", "ann_ord"], "row_id")
    rows = batch.dedupe(rows, "textdocument", "row_id", ["guid", "scene_label"], normalized=dedupe)
    return rows.select("row_id", "guid", "time_point", "scene_label", "confidence", "textdocument")


def review_batch(rows: DataFrame, paths: DataFrame, events: DataFrame) -> DataFrame:
    """Media paths, cleaned text and the folded review decisions, then the stage export
    (rows not deleted, review-only columns dropped, no missing values)."""
    enriched = review.with_cleaned_text(review.with_paths(rows, review.latest_paths(paths)))
    decided = review.apply_review(enriched, review.fold_review(events))
    return review.export_reviewed(decided)


def tag_batch(reviewed: DataFrame, model_factory: Callable, max_retries: int = 3,
              backoff_s: float = 1.0) -> DataFrame:
    return annotate(reviewed, model_factory, max_retries, backoff_s)


def adjudicate_batch(tagged: DataFrame, events: DataFrame, include_rejected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(checks per row of its last text: verbatim_ok, parse_error; final export of accepted
    rows, with the texts as last edited). Rows with rejected OCR are never accepted unless
    ``include_rejected``."""
    t = review.apply_adjudication(tagged.filter(F.col("tagged").isNotNull()), review.fold_adjudication(events),
                                  include_rejected=include_rejected)
    same = t.withColumn("verbatim_ok", verbatim_ok("tagged", "cleaned_text"))
    checks = bio.parse_errors(same, "row_id", "tagged", "verbatim_ok").select("row_id", "parse_error", "verbatim_ok")
    return checks, review.export_final(t)


def gold_frames(timeframes: DataFrame, annotations: DataFrame, pair_log: DataFrame | None = None,
                boxes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Sampled frames with their global index and each guid's progress, the frames still
    to annotate, each guid's next frame, and of the saved annotations (guid, frame_num,
    annotated, skip_reason, continuing, role, filler) the sources of duplicates and the
    chains with their bindings; with a pair log (guid, frame_num, seq, action, role,
    fillers) the bindings of each frame, with boxes those of the sampled frames."""
    sampled = frames.sample_frames(timeframes)
    indexed = frames.index_frames(sampled)
    done = annotations.select("guid", "frame_num")
    flagged = indexed.join(done.withColumn("annotated", F.lit(True)), ["guid", "frame_num"], "left") \
        .fillna(False, ["annotated"])
    out = {
        "frames": indexed,
        "progress": frames.progress(sampled, annotations),
        "todo": frames.todo_frames(sampled, annotations),
        "next": frames.next_todo(flagged),
    }
    if "skip_reason" in annotations.columns:
        out["duplicates"] = frames.resolve_duplicates(annotations)
    if "continuing" in annotations.columns:
        out["chains"] = frames.chain_bindings(frames.chains(annotations))
    if pair_log is not None:
        out["bindings"] = frames.fold_pairs(pair_log, ["guid", "frame_num"])
    if boxes is not None:
        out["boxes"] = boxes_for_frames(sampled, boxes)
    return out
