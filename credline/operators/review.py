"""Review and adjudication: stage columns, decision folds, exports, path enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credline.functions.text import clean_ocr, na_to_null
from credline.operators.batch import swap_label
from credline.schemas import REVIEW_EXPORT_DROP, REVIEW_FLAGS

SALT = 16


def add_missing_flags(df: DataFrame, flags: Sequence[str] = REVIEW_FLAGS) -> DataFrame:
    """Add every flag column that is absent, filled with False."""
    missing = {f: F.lit(False) for f in flags if f not in df.columns}
    return df.withColumns(missing) if missing else df


def with_cleaned_text(df: DataFrame, text: str = "textdocument") -> DataFrame:
    """Derive ``cleaned_text`` from the OCR text unless the column already exists."""
    return df if "cleaned_text" in df.columns else df.withColumn("cleaned_text", clean_ocr(text))


def normalize_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Turn the missing-value literals of a CSV stage file into NULL in string columns."""
    targets = [f.name for f in df.schema.fields
               if f.dataType.simpleString() == "string" and (cols is None or f.name in cols)]
    return df.withColumns({c: na_to_null(c) for c in targets}) if targets else df


def export_reviewed(df: DataFrame) -> DataFrame:
    """Close the OCR review stage: keep rows not deleted (NULL counts as not False),
    drop the review-only columns and every row with a missing value."""
    out = add_missing_flags(with_cleaned_text(df))
    out = out.filter(F.col("deleted") == F.lit(False))
    out = out.drop(*[c for c in REVIEW_EXPORT_DROP if c in out.columns])
    return out.na.drop("any")


def export_final(df: DataFrame, text_col: str = "tagged") -> DataFrame:
    """Close adjudication: accepted rows only, no missing values, five output columns."""
    out = df.filter(F.col("accepted") == F.lit(True)).na.drop("any")
    return out.select("guid", "time_point", "scene_label", "cleaned_text",
                      F.col(text_col).alias("labels"))


# --------------------------------------------------------------------------- review fold
def fold_review(events: DataFrame) -> DataFrame:
    """Review state per row from its action log (row_id, seq, action).

    Actions: ``reject`` toggles the pending rejection, ``swap`` toggles the scene label,
    ``delete`` toggles deletion and commits, ``submit`` commits, ``undo`` un-commits and
    clears the pending rejection. A commit stores ``ocr_accepted = not rejected``.

    Closed form: S = last commit, U = last undo before S, rejected at S = odd number of
    rejects in (U, S). Computed with partial aggregates; a row's S (and U) meets its events
    in joins salted by ``seq``, so a row with a huge log is dealt over ``SALT`` tasks, each
    of which aggregates its part before the next shuffle.
    """
    a = F.col("action")
    commit = a.isin("submit", "delete")
    # latest of submit/delete/undo packed into one long (seq * 8 + code): a fixed-width
    # buffer keeps the aggregation hash-based
    code = F.when(a == "undo", 1).when(commit, 2)
    per_row = events.groupBy("row_id").agg(
        (F.count_if(a == "swap") % 2 == 1).alias("label_adjusted"),
        (F.count_if(a == "delete") % 2 == 1).alias("deleted"),
        F.max(F.col("seq") * 8 + code).alias("_last"),
        F.max(F.when(commit, F.col("seq"))).alias("_s"))
    anchors = per_row.filter(F.col("_s").isNotNull()).select("row_id", "_s")
    salted = events.withColumn("_salt", F.pmod("seq", F.lit(SALT)).cast("int"))
    each = lambda df: df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    last_undo = (salted.filter(a == "undo").join(each(anchors), ["row_id", "_salt"])
                 .filter(F.col("seq") < F.col("_s"))
                 .groupBy("row_id").agg(F.max("seq").alias("_u")))
    rejects = (salted.filter(a == "reject").join(each(anchors.join(last_undo, "row_id", "left")), ["row_id", "_salt"])
               .filter((F.col("seq") < F.col("_s"))
                       & (F.col("_u").isNull() | (F.col("seq") > F.col("_u"))))
               .groupBy("row_id").agg(F.count(F.lit(1)).alias("_nrej")))
    out = per_row.join(rejects, "row_id", "left")
    return out.select(
        "row_id", "label_adjusted", "deleted",
        F.coalesce(F.pmod(F.col("_last"), F.lit(8)) == 2, F.lit(False)).alias("annotated"),
        (F.col("_s").isNotNull() & (F.coalesce(F.col("_nrej"), F.lit(0)) % 2 == 0)).alias("ocr_accepted"))


def fold_adjudication(events: DataFrame) -> DataFrame:
    """Adjudication state per row: the last of accept / reject / edit / undo wins; an
    edit or an undo clears the decision. ``edited`` is the payload of the last edit that
    carries one (NULL if none does, or if the log has no ``payload``); an undo takes back
    the decision, not the text."""
    a = F.col("action")
    # latest decision packed into one long (seq * 8 + code): 1 accept, 2 reject, 3 edit/undo
    code = F.when(a == "accept", 1).when(a == "reject", 2).when(a.isin("edit", "undo"), 3)
    payload = F.col("payload") if "payload" in events.columns else F.lit(None).cast("string")
    carries = (a == "edit") & payload.isNotNull()
    per_row = events.groupBy("row_id").agg(
        F.max(F.col("seq") * 8 + code).alias("_last"),
        F.max(F.when(carries, F.col("seq"))).alias("_edit"),
        F.count_if(a == "edit").alias("n_edits"))
    if "payload" in events.columns:  # texts meet only the one place that wants them
        edits = events.filter(carries).select("row_id", F.col("seq").alias("_edit"), F.col("payload").alias("edited"))
        per_row = per_row.join(edits, ["row_id", "_edit"], "left")
    else:
        per_row = per_row.withColumn("edited", payload)
    last = F.pmod(F.col("_last"), F.lit(8))
    return per_row.select(
        "row_id",
        F.coalesce(last.isin(1, 2), F.lit(False)).alias("adjudicated"),
        F.coalesce(last == 1, F.lit(False)).alias("accepted"),
        F.col("n_edits").cast("long").alias("n_edits"), "edited")


def apply_adjudication(rows: DataFrame, state: DataFrame, text_col: str = "tagged",
                       include_rejected: bool = False) -> DataFrame:
    """Fold adjudication state into tagged rows: the last edited text replaces the tagged
    one, decisions fill ``adjudicated`` and ``accepted``. Rows whose OCR was rejected never
    come up for adjudication, so they are never accepted; ``include_rejected`` keeps them
    as accepted with their all-outside tags."""
    s = state.select("row_id", *[F.col(c).alias(f"_st_{c}") for c in ("adjudicated", "accepted", "edited")])
    out = rows.join(s, "row_id", "left")
    rejected = (F.col("ocr_accepted") == F.lit(False)) if "ocr_accepted" in rows.columns else F.lit(False)
    rejected = F.coalesce(rejected, F.lit(False))
    false = F.lit(False)
    return (out.withColumn(text_col, F.when(rejected, F.col(text_col)).otherwise(F.coalesce("_st_edited", text_col)))
            .withColumn("adjudicated", ~rejected & F.coalesce("_st_adjudicated", false))
            .withColumn("accepted", F.when(rejected, F.lit(include_rejected)).otherwise(F.coalesce("_st_accepted", false)))
            .drop("_st_adjudicated", "_st_accepted", "_st_edited"))


def apply_review(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Fold review state into the batch rows: the latest decision wins over the stored
    flags, a toggled label is swapped."""
    s = state.select("row_id", *[F.col(c).alias(f"_st_{c}") for c in REVIEW_FLAGS])
    out = add_missing_flags(rows).join(s, "row_id", "left")
    for c in REVIEW_FLAGS:
        out = out.withColumn(c, F.coalesce(F.col(f"_st_{c}"), F.col(c)))
    out = out.withColumn("scene_label", F.when(F.col("_st_label_adjusted"), swap_label("scene_label"))
                         .otherwise(F.col("scene_label")))
    return out.drop(*[f"_st_{c}" for c in REVIEW_FLAGS])


# --------------------------------------------------------------------------- media paths
def latest_paths(path_rows: DataFrame, order: str = "file_ord") -> DataFrame:
    """One path per guid: a later file overrides an earlier one."""
    return path_rows.groupBy("guid").agg(F.max_by("path", order).alias("path"))


def with_paths(df: DataFrame, paths: DataFrame) -> DataFrame:
    """Left-join the path of each row's guid; AQE broadcasts the path table if it is small."""
    return df.join(paths, "guid", "left")


def missing_paths(df: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct guids that have no path (the lookups the reference would send to a
    remote search service)."""
    return df.select("guid").distinct().join(paths.select("guid"), "guid", "left_anti")
