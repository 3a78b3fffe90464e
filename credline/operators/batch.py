"""Batch building: scene labels, class arg-max, alignment resolution, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credline.functions.text import dedupe_key
from credline.operators.common import keep_first, materialize
from credline.schemas import CHYRON, CHYRON_CODES, CREDITS, CREDITS_CODES, GUID_PATTERN


def scene_label(code) -> Column:
    """Scene code -> ``chyron`` / ``credits``; NULL for every other code."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c.isin(*CHYRON_CODES), F.lit(CHYRON)).when(c.isin(*CREDITS_CODES), F.lit(CREDITS))


def map_scene(df: DataFrame, code: str = "scene_code", out: str = "scene_label") -> DataFrame:
    """Map scene codes to labels and drop the rows whose code maps to nothing."""
    return df.withColumn(out, scene_label(code)).filter(F.col(out).isNotNull())


def swap_label(label) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c == F.lit(CHYRON), F.lit(CREDITS)).otherwise(F.lit(CHYRON))


def argmax_class(scores) -> Column:
    """Arg-max over a ``map<string,double>``: struct(key, value); a tie goes to the entry
    that comes first in the map."""
    m = F.col(scores) if isinstance(scores, str) else scores
    best = F.array_max(F.transform(
        F.map_entries(m),
        lambda e, i: F.struct(e["value"].alias("v"), (-i).alias("neg_pos"), e["key"].alias("k"))))
    return F.struct(best["k"].alias("key"), best["v"].alias("value"))


def guid_from_location(location) -> Column:
    """Guid inside a media location; NULL when the pattern does not occur."""
    c = F.col(location) if isinstance(location, str) else location
    return F.nullif(F.regexp_extract(c, GUID_PATTERN, 1), F.lit(""))


def alignment_filter(df: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Keep alignments from a time point (``tp``) to a text document (``td``)."""
    return df.filter(F.col(source).contains("tp") & F.col(target).contains("td"))


def resolve_refs(refs: DataFrame, anns: DataFrame, file_cols: Sequence[str], ref: str,
                 payload: Sequence[str], prefix: str) -> DataFrame:
    """Resolve the annotation id in ``refs[ref]`` against ``anns``
    (file_cols, view_id, view_ord, ann_ord, ann_id, *payload).

    Tier 1: the document-wide id ``view_id:ann_id``. Tier 2: the bare id searched in every
    view, the last view holding it wins (in a view, the last annotation). Both tiers are
    settled on a narrow table of ids and places, keyed by (file, id), so a hot file spreads
    over many join keys; the payload is then fetched once, by its place. Unresolved ids
    give NULL payload columns.
    """
    fc = list(file_cols)
    ids = F.array(F.struct(F.lit(1).alias("tier"), F.concat_ws(":", "view_id", "ann_id").alias("id")),
                  F.struct(F.lit(0).alias("tier"), F.col("ann_id").alias("id")))
    places = (anns.select(*fc, "view_ord", "ann_ord", F.explode(ids).alias("_i"))
              .groupBy(*fc, F.col("_i.id").alias("_rid"))
              .agg(F.max(F.struct(F.col("_i.tier").alias("tier"), "view_ord", "ann_ord")).alias("_at")))
    found = (refs.withColumn("_rid", F.col(ref)).join(places, [*fc, "_rid"], "left")
             .withColumns({"_v": F.col("_at.view_ord"), "_a": F.col("_at.ann_ord")}).drop("_rid", "_at"))
    values = anns.select(*fc, F.col("view_ord").alias("_v"), F.col("ann_ord").alias("_a"),
                         *[F.col(p).alias(f"{prefix}{p}") for p in payload])
    return found.join(values, [*fc, "_v", "_a"], "left").drop("_v", "_a")


def dedupe_exact(df: DataFrame, text: str, order: str) -> DataFrame:
    """Exact distinct on ``text``, keeping the earliest row by ``order``.

    Keyed by the SHA-256 digest of the text: the shuffle carries 32 bytes per row instead
    of the text, and map-side partial aggregation collapses hot texts before the shuffle.
    """
    return keep_first(df, [F.sha2(F.col(text), 256)], order)


def dedupe_normalized(df: DataFrame, keys: Sequence[str], text: str, order: str) -> DataFrame:
    """Near-duplicate distinct on (keys..., normalised text), keeping the earliest row."""
    return keep_first(df, [*(F.col(k) for k in keys), dedupe_key(text)], order)


def dedupe(df: DataFrame, text: str, order: str, keys: Sequence[str] = (),
           normalized: bool = False) -> DataFrame:
    """Keep-first de-duplication in the workflow's stage order: with ``normalized``,
    near-duplicates on (keys..., normalised text) go first, then exact duplicates of the
    text among the survivors.

    The text is read twice in all: once to build a narrow table (order, keys, SHA-256 of
    the normalised and of the exact text) that is written once, and once by the final
    semi join on the unique ``order`` column. Both winner searches are partial
    aggregates over the narrow table, so a text repeated by a third of all rows is
    collapsed map-side and never shuffled whole.
    """
    narrow = df.select(F.col(order), *[F.col(k) for k in keys],
                       F.sha2(dedupe_key(text), 256).alias("_k_norm"),
                       F.sha2(F.col(text), 256).alias("_k_exact"))
    narrow = materialize(narrow, "dedupe-keys")
    if normalized:
        narrow = keep_first(narrow, [*keys, "_k_norm"], order)
    winners = narrow.groupBy("_k_exact").agg(F.min(order).alias(order)).select(order)
    return df.join(winners, order, "left_semi")


def label_rollup(df: DataFrame, label: str = "scene_label") -> DataFrame:
    """Per-label counts plus the grand total (label NULL)."""
    return df.rollup(label).agg(F.count(F.lit(1)).alias("n"))
