"""Registered queries: one Spark plan per operator family, each with its DuckDB oracle.

Every query reads the driver tables of ``sf_dir`` whole (through the adapter views) and
returns a DataFrame whose columns are named exactly like the oracle's.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credline.functions.text import clean_ocr, split_lines_stripped, tag_all_o, tokens, verbatim_ok
from credline.operators import batch, bio, boxes, frames, review
from credline.operators.apply import annotate, ocr_frames, routed, with_request
from credline.operators.common import global_index, materialize
from credline.operators.tagging import call_pending, tagged_rows
from credline.plans import flows
from credline.plans import oracle as O
from credline.plans import views as V
from credline.schemas import OCR_ROW, STAGES
from credline.session import scratch_path
from credline.sources import annotation_json as AJ
from credline.sources import gold_store, tables
from credline.sources.csv_split import read_csv_checked
from credline.sources.files import list_frames, read_path_dim, write_frames
from credline.streaming.bounded import adjudication_state_bounded, review_state_bounded
from credline.streaming.incremental import stage_hop
from credline.streaming.progress import progress_stream, progress_table
from credline.streaming.session import LOG, ignored_events, last_records, replay_sessions
from credline.streaming.state import adjudication_state_stream, review_state_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _mapped(spark, sf) -> DataFrame:
    return batch.map_scene(V.v_ocr_rows(spark, sf))


# =========================================================================== batch building
@register("q_curate_batch", O.with_views(["v_mapped"], f"""
, n as (select * from v_mapped where row_id in (
        select min(row_id) from v_mapped group by guid, scene_label, {O.norm_key('textdocument')}))
, e as (select * from n where row_id in (select min(row_id) from n group by textdocument))
select row_id, guid, time_point, scene_label, {O.clean('textdocument')} as cleaned_text
from e where deleted = false and {O.clean('textdocument')} <> ''""".lstrip()))
def q_curate_batch(spark, sf):
    """Flagship: scene map -> near-duplicate then exact de-dup (keep first) -> clean ->
    drop deleted and empty rows."""
    rows = batch.dedupe(_mapped(spark, sf), "textdocument", "row_id", ["guid", "scene_label"], normalized=True)
    rows = rows.withColumn("cleaned_text", clean_ocr("textdocument"))
    rows = rows.filter((F.col("deleted") == F.lit(False)) & (F.col("cleaned_text") != ""))
    return rows.select("row_id", "guid", "time_point", "scene_label", "cleaned_text")


@register("q_scan_roundtrip", O.with_views(["v_ocr_rows"], """
select row_id, guid, time_point, scene_code as scene_label, confidence, textdocument from v_ocr_rows"""))
def q_scan_roundtrip(spark, sf):
    """Stage CSV sink and scan: quoted multi-line text survives the round trip."""
    src = V.v_ocr_rows(spark, sf).select("row_id", "guid", "time_point",
                                         F.col("scene_code").alias("scene_label"),
                                         "confidence", "textdocument")
    path = scratch_path(spark, "csv")
    tables.write_csv(src, path)
    schema = T.StructType([T.StructField("row_id", T.LongType())] + OCR_ROW.fields)
    return tables.read_csv(spark, path, schema).select(
        "row_id", "guid", "time_point", "scene_label", "confidence", "textdocument")


@register("q_clean_text", O.with_views(["v_ocr_rows"], f"""
select row_number() over (order by row_id) - 1 as idx, row_id,
       {O.clean('textdocument')} as cleaned from v_ocr_rows"""))
def q_clean_text(spark, sf):
    """Column-pruned scan of the text, cleaning, 0-based row-number index. Only the ids are sorted
    and written for the index; the texts meet it by id and are cleaned where they are."""
    rows = V.v_ocr_rows(spark, sf)
    idx = global_index(rows.select("row_id"), ["row_id"], "idx")
    return rows.select("row_id", "textdocument").join(idx, "row_id").select("idx", "row_id", clean_ocr("textdocument").alias("cleaned"))


@register("q_token_counts", O.with_views(["v_ocr_rows"], f"""
select row_id, cast(len({O.tokens('textdocument')}) as bigint) as n_tokens from v_ocr_rows"""))
def q_token_counts(spark, sf):
    return V.v_ocr_rows(spark, sf).select(
        "row_id", F.size(tokens("textdocument")).cast("long").alias("n_tokens"))


@register("q_scene_map", O.with_views(["v_mapped"], """
select row_id, guid, scene_code, scene_label from v_mapped"""))
def q_scene_map(spark, sf):
    return _mapped(spark, sf).select("row_id", "guid", "scene_code", "scene_label")


@register("q_label_rollup", O.with_views(["v_mapped"], """
select scene_label, count(*) as n from v_mapped group by rollup(scene_label)"""))
def q_label_rollup(spark, sf):
    return batch.label_rollup(_mapped(spark, sf)).withColumn("n", F.col("n").cast("long"))


# one class per embedding entry: the first six are scene codes, the others map to no label
_CLASSES = ("I", "N", "Y", "C", "S", "B", *(f"X{i}" for i in range(6, 64)))
_TOP = f"[{', '.join(repr(c) for c in _CLASSES)}][list_position(s, list_max(s))]"


@register("q_argmax_class", f"""
with e as (select vec_id, list_transform(embedding, lambda x: floor(cast(x as double) * 10) / 10.0) as s from embeddings)
select vec_id, {_TOP} as top_class, list_max(s) as top_score, {O.label(_TOP)} as scene_label
from e""")
def q_argmax_class(spark, sf):
    """Arg-max over class scores (every embedding entry, one decimal), first max wins."""
    e = V.table(spark, sf, "embeddings")
    scores = F.map_from_arrays(
        F.array(*[F.lit(c) for c in _CLASSES]),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 10) / 10.0))
    best = batch.argmax_class(scores)
    return e.select("vec_id", best["key"].alias("top_class"), best["value"].alias("top_score"),
                    batch.scene_label(best["key"]).alias("scene_label"))


@register("q_dedupe_exact", O.with_views(["v_ocr_rows"], """
select row_id, guid from v_ocr_rows
where row_id in (select min(row_id) from v_ocr_rows group by textdocument)"""))
def q_dedupe_exact(spark, sf):
    return batch.dedupe_exact(V.v_ocr_rows(spark, sf), "textdocument", "row_id").select("row_id", "guid")


@register("q_dedupe_norm", O.with_views(["v_mapped"], f"""
, n as (select * from v_mapped qualify row_number() over (
        partition by guid, scene_label, {O.norm_key('textdocument')} order by row_id) = 1)
select row_id, guid, scene_label from n
qualify row_number() over (partition by textdocument order by row_id) = 1""".lstrip()))
def q_dedupe_norm(spark, sf):
    """Near-duplicate distinct on (guid, label, normalised text) first, exact after."""
    rows = batch.dedupe(_mapped(spark, sf), "textdocument", "row_id", ["guid", "scene_label"], normalized=True)
    return rows.select("row_id", "guid", "scene_label")


@register("q_align_filter", O.with_views(["v_alignment"], """
select doc_id, view_id, source_id, target_id from v_alignment
where contains(source_id, 'tp') and contains(target_id, 'td')"""))
def q_align_filter(spark, sf):
    return batch.alignment_filter(V.v_alignment(spark, sf))


def _ann_tables(spark, sf):
    d = V.documents(spark, sf)
    sid = F.col("doc_id").cast("string")
    td1 = d.select(F.col("source").alias("file"), F.concat(F.lit("v_"), "source").alias("view_id"),
                   F.lit(0).cast("long").alias("view_ord"), F.col("doc_id").alias("ann_ord"),
                   F.concat(F.lit("td_"), sid).alias("ann_id"), F.col("text"))
    td2 = d.select(F.col("source").alias("file"), F.lit("v_ocr2").alias("view_id"),
                   F.lit(1).cast("long").alias("view_ord"), F.col("doc_id").alias("ann_ord"),
                   F.concat(F.lit("td_"), sid).alias("ann_id"), F.concat(F.lit("[v2] "), F.col("text")).alias("text"))
    tp = d.select(F.col("source").alias("file"), F.concat(F.lit("v_"), "source").alias("view_id"),
                  F.lit(0).cast("long").alias("view_ord"), F.col("doc_id").alias("ann_ord"),
                  F.concat(F.lit("tp_"), sid).alias("ann_id"), (F.col("doc_id") * 1000).alias("time_point"))
    return td1.unionByName(td2), tp


@register("q_align_join", O.with_views(["v_alignment"], """
, td as (select source as file, 'v_' || source as view_id, 0 as view_ord,
                'td_' || cast(doc_id as varchar) as ann_id, text from documents
         union all
         select source, 'v_ocr2', 1, 'td_' || cast(doc_id as varchar), '[v2] ' || text from documents)
, tp as (select source as file, 'v_' || source as view_id, 0 as view_ord,
                'tp_' || cast(doc_id as varchar) as ann_id, doc_id*1000 as time_point from documents)
, al as (select a.doc_id, d.source as file,
                case when a.doc_id % 2 = 0 then a.view_id || ':' || a.source_id else a.source_id end as src_ref,
                case when a.doc_id % 3 = 0 then a.view_id || ':' || a.target_id else a.target_id end as tgt_ref
         from v_alignment a join documents d on a.doc_id = d.doc_id
         where contains(a.source_id, 'tp') and contains(a.target_id, 'td'))
select al.doc_id,
  coalesce((select arg_max(text, view_ord) from td where td.file = al.file and td.view_id || ':' || td.ann_id = al.tgt_ref),
           (select arg_max(text, view_ord) from td where td.file = al.file and td.ann_id = al.tgt_ref)) as textdocument,
  coalesce((select arg_max(time_point, view_ord) from tp where tp.file = al.file and tp.view_id || ':' || tp.ann_id = al.src_ref),
           (select arg_max(time_point, view_ord) from tp where tp.file = al.file and tp.ann_id = al.src_ref)) as time_point
from al""".lstrip()))
def q_align_join(spark, sf):
    """Two-tier id resolution of alignment targets (text) and sources (time points):
    document-wide ``view:id`` first, else the bare id in the last view holding it."""
    td, tp = _ann_tables(spark, sf)
    d = V.documents(spark, sf).select("doc_id", F.col("source").alias("file"))
    al = batch.alignment_filter(V.v_alignment(spark, sf)).join(d, "doc_id")
    al = al.select(
        "doc_id", "file",
        F.when(F.col("doc_id") % 2 == 0, F.concat_ws(":", "view_id", "source_id"))
         .otherwise(F.col("source_id")).alias("src_ref"),
        F.when(F.col("doc_id") % 3 == 0, F.concat_ws(":", "view_id", "target_id"))
         .otherwise(F.col("target_id")).alias("tgt_ref"))
    r = batch.resolve_refs(al, td, ["file"], "tgt_ref", ["text"], "td_")
    r = batch.resolve_refs(r, tp, ["file"], "src_ref", ["time_point"], "tp_")
    return r.select("doc_id", F.col("td_text").alias("textdocument"), F.col("tp_time_point").alias("time_point"))


def _annotation_json(spark, sf) -> DataFrame:
    """One annotation document per source document (JSON text, key doc_id)."""
    d = V.documents(spark, sf)
    props = lambda **kw: F.struct(*[
        (kw[f.name] if f.name in kw else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in AJ.ANNOTATION_DOC["views"].dataType.elementType["annotations"]
        .dataType.elementType["properties"].dataType.fields])
    ann = lambda typ, p: F.struct(F.lit(typ).alias("@type"), p.alias("properties"))
    cls = F.create_map(
        F.lit("I"), (F.col("n_chars") % 7).cast("double") / 10.0,
        F.lit("N"), (F.col("doc_id") % 4).cast("double") / 10.0,
        F.lit("C"), (F.col("n_chars") % 5).cast("double") / 10.0,
        F.lit("S"), (F.col("n_chars") % 3).cast("double") / 10.0)
    src = (F.when(F.col("doc_id") % 5 == 0, "bb_1").when(F.col("doc_id") % 2 == 0, "v1:tp_1")
           .otherwise("tp_1"))
    tgt = (F.when(F.col("doc_id") % 7 == 0, "tok_1").when(F.col("doc_id") % 3 == 0, "v1:td_1")
           .otherwise("td_1"))
    v1 = F.struct(F.lit("v1").alias("id"), F.array(
        ann("http://vocab/TimePoint", props(id=F.lit("tp_1"), timePoint=F.col("doc_id") * 1000,
                                            classification=cls)),
        ann("http://vocab/TextDocument", props(id=F.lit("td_1"), text=F.struct(F.col("text").alias("@value")))),
    ).alias("annotations"))
    v2 = F.struct(F.lit("v2").alias("id"), F.array(
        ann("http://vocab/Alignment", props(id=F.lit("al_1"), source=src, target=tgt)),
        ann("http://vocab/TextDocument", props(id=F.lit("td_1"), text=F.struct(
            F.concat(F.lit("[v2] "), F.col("text")).alias("@value")))),
    ).alias("annotations"))
    media = lambda i, mime, where: F.struct(F.lit("http://vocab/VideoDocument").alias("@type"), F.struct(
        F.lit(i).alias("id"), F.lit(mime).alias("mime"), where.alias("location")).alias("properties"))
    # the last document whose type is exactly ``video`` names the guid
    docs = F.array(media("d1", "video", F.lit("/media/cpb-aacip-first.mp4")),
                   media("d2", "video", F.concat(F.lit("/media/cpb-aacip-"), F.col("source"), F.lit(".mp4"))),
                   media("d3", "video/mp4", F.lit("/media/cpb-aacip-other.mp4")))
    doc = F.struct(docs.alias("documents"), F.array(v1, v2).alias("views"))
    return d.select(F.col("doc_id").alias("doc_key"), F.to_json(doc).alias("value"))


@register("q_json_flatten", f"""
with d as (select doc_id, source, text, n_chars,
                  [cast(n_chars % 7 as double)/10.0, cast(doc_id % 4 as double)/10.0,
                   cast(n_chars % 5 as double)/10.0, cast(n_chars % 3 as double)/10.0] as s,
                  case when doc_id % 5 = 0 then 'bb_1' when doc_id % 2 = 0 then 'v1:tp_1' else 'tp_1' end as src,
                  case when doc_id % 7 = 0 then 'tok_1' when doc_id % 3 = 0 then 'v1:td_1' else 'td_1' end as tgt
           from documents)
, r as (select 'cpb-aacip-' || source as guid, doc_id*1000 as time_point,
               ['I','N','C','S'][list_position(s, list_max(s))] as scene_code, list_max(s) as confidence,
               {O.strip("case when tgt = 'v1:td_1' then text else '[v2] ' || text end")} as textdocument
        from d where contains(src, 'tp') and contains(tgt, 'td'))
select guid, time_point, scene_code, confidence, {O.label('scene_code')} as scene_label, textdocument
from r where {O.label('scene_code')} is not null""")
def q_json_flatten(spark, sf):
    """Annotation JSON: one annotation document per source document is written as JSON
    Lines, scanned, parsed with an explicit schema and flattened (documents -> views ->
    annotations -> two-tier id joins -> class arg-max -> scene labels)."""
    path = scratch_path(spark, "json")
    _annotation_json(spark, sf).select("value").write.text(path)
    docs = AJ.read_annotation_docs(spark, path, one_per_file=False)
    rows = AJ.ocr_rows(AJ.materialize_annotations(spark, docs))
    return rows.select("guid", "time_point", "scene_code", "confidence", "scene_label", "textdocument")


@register("q_union_batches", O.with_views(["v_ocr_rows"], """
select row_id, guid, 'a' as batch, null::varchar as note from v_ocr_rows where scene_code in ('I', 'N')
union all
select row_id, guid, 'b' as batch, 'late' as note from v_ocr_rows where scene_code not in ('I', 'N')"""))
def q_union_batches(spark, sf):
    """Batches with different columns united by name (missing columns become NULL)."""
    rows = V.v_ocr_rows(spark, sf)
    a = rows.filter(F.col("scene_code").isin("I", "N")).select("row_id", "guid", F.lit("a").alias("batch"))
    b = rows.filter(~F.col("scene_code").isin("I", "N")).select(
        "row_id", "guid", F.lit("b").alias("batch"), F.lit("late").alias("note"))
    return a.unionByName(b, allowMissingColumns=True)


@register("q_guid_extract", O.with_views(["v_path_rows"], """
, p as (select file_ord as page_id,
               case when file_ord % 2 = 0 then '/d/' || guid || '.mp4' else guid end as location
        from v_path_rows)
select page_id, location, nullif(regexp_extract(location, '(cpb-aacip[-_][a-z0-9-]+).', 1), '') as guid
from p""".lstrip()))
def q_guid_extract(spark, sf):
    p = V.v_path_rows(spark, sf)
    loc = F.when(F.col("file_ord") % 2 == 0, F.concat(F.lit("/d/"), "guid", F.lit(".mp4"))).otherwise(F.col("guid"))
    return p.select(F.col("file_ord").alias("page_id"), loc.alias("location")).withColumn(
        "guid", batch.guid_from_location("location"))


# =========================================================================== review
_PATHS_SQL = "select guid, arg_max(path, file_ord) as path from v_path_rows group by guid"


@register("q_path_lookup", O.with_views(["v_ocr_rows", "v_path_rows"], f"""
, p as ({_PATHS_SQL})
select row_id, guid, path from v_ocr_rows left join p using (guid)""".lstrip()))
def q_path_lookup(spark, sf):
    paths = review.latest_paths(V.v_path_rows(spark, sf))
    return review.with_paths(V.v_ocr_rows(spark, sf).select("row_id", "guid"), paths) \
        .select("row_id", "guid", "path")


@register("q_path_missing", O.with_views(["v_ocr_rows", "v_path_rows"], f"""
, p as ({_PATHS_SQL})
select distinct guid from v_ocr_rows where guid not in (select guid from p)""".lstrip()))
def q_path_missing(spark, sf):
    paths = review.latest_paths(V.v_path_rows(spark, sf))
    return review.missing_paths(V.v_ocr_rows(spark, sf), paths)


def _na_injected(rows: DataFrame) -> DataFrame:
    t = (F.when(F.col("row_id") % 11 == 0, "NA").when(F.col("row_id") % 11 == 1, "")
         .when(F.col("row_id") % 11 == 2, "null").when(F.col("row_id") % 11 == 3, " NA")
         .otherwise(F.col("textdocument")))
    g = F.when(F.col("row_id") % 13 == 0, F.lit("N/A")).otherwise(F.col("guid"))
    return rows.select("row_id", g.alias("guid"), t.alias("textdocument"))


@register("q_dropna", O.with_views(["v_ocr_rows"], f"""
, x as (select row_id,
               case when row_id % 13 = 0 then 'N/A' else guid end as guid,
               case row_id % 11 when 0 then 'NA' when 1 then '' when 2 then 'null' when 3 then ' NA'
                    else textdocument end as textdocument
        from v_ocr_rows)
select row_id, guid from x where guid not in ({O.NA_LIST}) and textdocument not in ({O.NA_LIST})""".lstrip()))
def q_dropna(spark, sf):
    """Missing-value literals of a CSV stage become NULL; rows with any NULL go."""
    x = review.normalize_missing(_na_injected(V.v_ocr_rows(spark, sf)))
    return x.na.drop("any").select("row_id", "guid")


@register("q_review_export", O.with_views(["v_mapped"], f"""
select row_id, guid, time_point, scene_code, textdocument, ocr_accepted, scene_label,
       {O.clean('textdocument')} as cleaned_text
from v_mapped where deleted = false"""))
def q_review_export(spark, sf):
    """OCR review submit: default flags, derived cleaned text, keep not-deleted rows, drop
    review-only columns and rows with missing values."""
    return review.export_reviewed(_mapped(spark, sf)).select(
        "row_id", "guid", "time_point", "scene_code", "textdocument", "ocr_accepted",
        "scene_label", "cleaned_text")


_REVIEW_FOLD_SQL = """
, w as (select *, sum(case when action = 'undo' then 1 else 0 end) over (
            partition by row_id order by seq rows between unbounded preceding and current row) as ug
        from v_review_events)
, w2 as (select *, sum(case when action = 'reject' then 1 else 0 end) over (
             partition by row_id, ug order by seq rows between unbounded preceding and current row) % 2 as rej
         from w)
, fold as (
select row_id,
       sum(case when action = 'swap' then 1 else 0 end) % 2 = 1 as label_adjusted,
       sum(case when action = 'delete' then 1 else 0 end) % 2 = 1 as deleted,
       coalesce(arg_max(action, seq) filter (where action in ('submit', 'delete', 'undo')) <> 'undo', false) as annotated,
       coalesce(arg_max(rej, seq) filter (where action in ('submit', 'delete')) = 0, false) as ocr_accepted
from w2 group by row_id)"""


@register("q_review_fold", O.with_views(["v_review_events"], _REVIEW_FOLD_SQL.lstrip() + """
select * from fold"""))
def q_review_fold(spark, sf):
    """Review state per row folded from the action log (reject/swap/delete/submit/undo)."""
    return review.fold_review(V.v_review_events(spark, sf).select("row_id", "seq", "action"))


@register("q_adjudicate_fold", O.with_views(["v_adjudication_events"], """
select row_id,
       coalesce(arg_max(action, seq) filter (where action in ('accept','reject','edit','undo'))
                in ('accept', 'reject'), false) as adjudicated,
       coalesce(arg_max(action, seq) filter (where action in ('accept','reject','edit','undo'))
                = 'accept', false) as accepted,
       count(*) filter (where action = 'edit') as n_edits,
       arg_max(payload, seq) filter (where action = 'edit' and payload is not null) as edited
from v_adjudication_events group by row_id"""))
def q_adjudicate_fold(spark, sf):
    return review.fold_adjudication(V.v_adjudication_events(spark, sf))


_ADJUDICATED_SQL = """
, adj as (select row_id, coalesce(arg_max(action, seq) filter (where action in ('accept','reject','edit','undo'))
                                  = 'accept', false) as accepted,
                 coalesce(arg_max(action, seq) filter (where action in ('accept','reject','edit','undo'))
                          in ('accept', 'reject'), false) as adjudicated,
                 arg_max(payload, seq) filter (where action = 'edit' and payload is not null) as edited
          from v_adjudication_events group by row_id)
, t as (select m.row_id, m.guid, m.time_point, m.scene_label, m.ocr_accepted, t.cleaned_text,
               case when m.ocr_accepted then coalesce(a.edited, t.tagged) else t.tagged end as tagged,
               m.ocr_accepted and coalesce(a.adjudicated, false) as adjudicated,
               m.ocr_accepted and coalesce(a.accepted, false) as accepted
        from v_mapped m join v_tagged t on t.doc_id = m.row_id left join adj a on a.row_id = m.row_id)"""


def _tagged_rows(spark, sf) -> DataFrame:
    tagged = V.v_tagged(spark, sf).withColumnRenamed("doc_id", "row_id")
    return _mapped(spark, sf).select("row_id", "guid", "time_point", "scene_label", "ocr_accepted").join(tagged, "row_id")


@register("q_adjudicate_edit", O.with_views(["v_mapped", "v_tagged", "v_adjudication_events"], _ADJUDICATED_SQL.lstrip() + """
select row_id, tagged, adjudicated, accepted from t"""))
def q_adjudicate_edit(spark, sf):
    """Decisions and the last edited text applied to tagged rows; rows with rejected OCR never
    come up."""
    state = review.fold_adjudication(V.v_adjudication_events(spark, sf))
    return review.apply_adjudication(_tagged_rows(spark, sf), state).select("row_id", "tagged", "adjudicated", "accepted")


@register("q_adjudicate_rejected", O.with_views(["v_mapped", "v_tagged", "v_adjudication_events"], _ADJUDICATED_SQL.lstrip() + """
select row_id, not ocr_accepted or accepted as accepted from t"""))
def q_adjudicate_rejected(spark, sf):
    """The option that keeps rows with rejected OCR."""
    state = review.fold_adjudication(V.v_adjudication_events(spark, sf))
    return review.apply_adjudication(_tagged_rows(spark, sf), state, include_rejected=True).select("row_id", "accepted")


@register("q_apply_decisions", O.with_views(["v_mapped", "v_review_events"], _REVIEW_FOLD_SQL.lstrip() + """
select m.row_id,
       case when f.label_adjusted then (case when m.scene_label = 'chyron' then 'credits' else 'chyron' end)
            else m.scene_label end as scene_label,
       coalesce(f.annotated, m.annotated) as annotated,
       coalesce(f.ocr_accepted, m.ocr_accepted) as ocr_accepted,
       coalesce(f.deleted, m.deleted) as deleted,
       coalesce(f.label_adjusted, false) as label_adjusted
from v_mapped m left join fold f on m.row_id = f.row_id"""))
def q_apply_decisions(spark, sf):
    state = review.fold_review(V.v_review_events(spark, sf).select("row_id", "seq", "action"))
    rows = _mapped(spark, sf).select("row_id", "guid", "scene_label", "annotated", "ocr_accepted", "deleted")
    return review.apply_review(rows, state).select(
        "row_id", "scene_label", "annotated", "ocr_accepted", "deleted", "label_adjusted")


@register("q_final_export", O.with_views(["v_mapped", "v_tagged", "v_adjudication_events"], _ADJUDICATED_SQL.lstrip() + """
select guid, time_point, scene_label, cleaned_text, tagged as labels from t where accepted"""))
def q_final_export(spark, sf):
    """Adjudication submit: accepted rows with their last text, no missing values, five
    columns."""
    state = review.fold_adjudication(V.v_adjudication_events(spark, sf))
    return review.export_final(review.apply_adjudication(_tagged_rows(spark, sf), state))


_STAGE_SQL = ("case when not annotated then '1-ocr-in-progress' when not ocr_accepted then '2-ocr-complete' "
              "when deleted then '3-llm-in-progress' else '4-llm-complete' end")


@register("q_stage_counts", O.with_views(["v_ocr_rows"], f"""
select {_STAGE_SQL} as stage, count(*) as n from v_ocr_rows group by 1"""))
def q_stage_counts(spark, sf):
    """Rows written into one folder per stage (a column, nothing deleted), then counted
    per stage from the written table."""
    rows = V.v_ocr_rows(spark, sf).withColumn("stage", F.expr(_STAGE_SQL))
    path = scratch_path(spark, "stages")
    rows = rows.select("row_id", "guid", "stage")
    tables.write_stages(rows.filter("row_id % 2 = 0"), path, "a")
    for _ in range(2):  # a batch written again replaces itself
        tables.write_stages(rows.filter("row_id % 2 = 1"), path, "b")
    return tables.read_stage(spark, path).groupBy("stage").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("q_stage_handoff", O.with_views(["v_ocr_rows"], """
select row_id, guid, '1-ocr-in-progress' as stage from v_ocr_rows
union all select row_id, guid, '2-ocr-complete' from v_ocr_rows where not deleted"""))
def q_stage_handoff(spark, sf):
    """Stage hand-off: batches arrive one after the other in the first stage, each hop moves
    what is new on to the second; nothing is deleted or moved twice."""
    rows = V.v_ocr_rows(spark, sf).select("row_id", "guid", "deleted").withColumn("stage", F.lit(STAGES[0]))
    path, ckpt = scratch_path(spark, "stages"), scratch_path(spark, "stages-ckpt")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "stage"])
    for batch, odd in (("a", 0), ("b", 1)):
        tables.write_stages(rows.filter(F.pmod("row_id", F.lit(2)) == odd), path, batch)
        stage_hop(spark, f"{path}/stage={STAGES[0]}", schema, f"{path}/stage={STAGES[1]}", ckpt,
                  lambda df: df.filter(~F.col("deleted")))
    one = lambda st: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(
        f"{path}/stage={st}").select("row_id", "guid", F.lit(st).alias("stage"))
    return one(STAGES[0]).unionByName(one(STAGES[1]))


@register("q_csv_hop", O.with_views(["v_ocr_rows"], """
select row_id, guid, time_point, textdocument from v_ocr_rows"""))
def q_csv_hop(spark, sf):
    """A hop over CSV stage files: headers are skipped, quoted line breaks stay in their row."""
    src = V.v_ocr_rows(spark, sf).select("row_id", "guid", "time_point", "textdocument")
    path, sink, ckpt = (scratch_path(spark, f"csv-hop-{n}") for n in ("in", "out", "ckpt"))
    tables.write_csv(src, path, time_header="time_point")
    stage_hop(spark, path, src.schema, sink, ckpt, glob="*.csv", fmt="csv", options=tables.CSV_OPTIONS)
    return spark.read.parquet(sink).select("row_id", "guid", "time_point", "textdocument")


@register("q_csv_mixed", O.with_views(["v_ocr_rows"], """
select row_id, guid, time_point, scene_code as scene_label, case when row_id % 2 = 0 then confidence end as confidence, textdocument
from v_ocr_rows"""))
def q_csv_mixed(spark, sf):
    """Stage files of one folder with differing headers: another order, another spelling of
    the time column, a column less. Columns go by name."""
    src = V.v_ocr_rows(spark, sf).withColumnRenamed("scene_code", "scene_label")
    path = scratch_path(spark, "csv-mixed")
    even, odd = (src.filter(F.pmod("row_id", F.lit(2)) == i) for i in (0, 1))
    tables.write_csv(even.select("row_id", "guid", "time_point", "scene_label", "confidence", "textdocument"), f"{path}/a")
    tables.write_csv(odd.select("textdocument", "scene_label", "row_id", "time_point", "guid"), f"{path}/b", time_header="timePoint")
    schema = T.StructType([T.StructField("row_id", T.LongType())] + OCR_ROW.fields)
    return tables.read_csv(spark, f"{path}/*", schema).select(
        "row_id", "guid", "time_point", "scene_label", "confidence", "textdocument")


_BAD_CSV_SQL = """
, c as (select row_id, guid, case when row_id % 11 = 3 then 'soon' else cast(time_point as varchar) end as time_point, textdocument from v_ocr_rows)"""


@register("q_csv_quarantine", O.with_views(["v_ocr_rows"], _BAD_CSV_SQL.lstrip() + """
select row_id, guid, time_point::bigint as time_point, textdocument, null as reason from c where row_id % 11 <> 3
union all select row_id, null, null, null, 'time_point is no bigint: soon' from c where row_id % 11 = 3
union all select row_id, null, null, null, 'not 4 fields' from c where row_id % 13 = 4"""))
def q_csv_quarantine(spark, sf):
    """Quoted multi-line CSV read in splits: values of another type and rows with a field too many
    are set aside with the reason, all other rows come through whole."""
    src = V.v_ocr_rows(spark, sf)
    path = scratch_path(spark, "csv-bad")
    time = F.when(F.col("row_id") % 11 == 3, F.lit("soon")).otherwise(F.col("time_point").cast("string"))
    tables.write_csv(src.select("row_id", "guid", time.alias("time_point"), "textdocument"), f"{path}/a", time_header="timePoint")
    wide = src.filter("row_id % 13 = 4").select(F.concat_ws(",", "row_id", F.lit("g"), F.lit("1"), F.lit('"a\n""b"""'), F.lit("more")).alias("value"))
    head = spark.createDataFrame([("row_id,guid,timePoint,textdocument",)], "value string")
    head.coalesce(1).unionByName(wide.coalesce(1)).coalesce(1).write.text(f"{path}/b")
    schema = T.StructType([T.StructField("row_id", T.LongType())] + OCR_ROW.fields)
    rows, bad = read_csv_checked(spark, f"{path}/*", schema)
    none = F.lit(None)
    return rows.select("row_id", "guid", "time_point", "textdocument", none.cast("string").alias("reason")).unionByName(bad.select(
        F.split("record", ",")[0].cast("long").alias("row_id"), none.cast("string").alias("guid"), none.cast("long").alias("time_point"),
        none.cast("string").alias("textdocument"), "reason"))


@register("q_path_files", """
with p as (select page_id % 3 as f, page_id, 'cpb-aacip-src' || cast(page_id % 15 as varchar) as guid, url from pages)
select guid, arg_max(url, f * 1000000000 + page_id) as path from p group by guid""")
def q_path_files(spark, sf):
    """Path files: a later file overrides an earlier one, a later row an earlier one of its
    file."""
    pages = V.table(spark, sf, "pages")
    base = scratch_path(spark, "paths")
    for f in range(3):
        (pages.filter(F.pmod("page_id", F.lit(3)) == f).orderBy("page_id")
         .select(F.concat(F.lit("cpb-aacip-src"), (F.col("page_id") % 15).cast("string")).alias("guid"), F.col("url").alias("path"))
         .write.option("header", "true").csv(f"{base}/{f}-paths.csv"))
    return review.latest_paths(read_path_dim(spark, f"{base}/*paths.csv"))


@register("q_tag_all_o", O.with_views(["v_mapped"], f"""
select row_id, array_to_string(list_transform({O.tokens(O.clean('textdocument'))}, lambda t: t || '@O'), ' ') as tagged
from v_mapped where ocr_accepted = false"""))
def q_tag_all_o(spark, sf):
    rows = _mapped(spark, sf).filter(F.col("ocr_accepted") == F.lit(False))
    return rows.select("row_id", tag_all_o(clean_ocr("textdocument")).alias("tagged"))


# every 19th row has no text, every 19th an empty one
_ROUTE_TEXT_SQL = f"case row_id % 19 when 3 then null when 4 then '' else {O.clean('textdocument')} end"


def _route_rows(spark, sf) -> DataFrame:
    text = (F.when(F.col("row_id") % 19 == 3, F.lit(None)).when(F.col("row_id") % 19 == 4, F.lit(""))
            .otherwise(clean_ocr("textdocument")))
    return V.v_ocr_rows(spark, sf).select(
        "row_id", "ocr_accepted", F.coalesce(batch.scene_label("scene_code"), F.col("scene_code")).alias("scene_label"),
        text.alias("cleaned_text"))


@register("q_tag_route", O.with_views(["v_ocr_rows"], f"""
select row_id,
       case when ocr_accepted = false then 'rejected'
            when coalesce({O.label('scene_code')}, scene_code) = 'chyron' then 'chyron'
            when coalesce({O.label('scene_code')}, scene_code) = 'credits' then 'credits'
            else 'unroutable' end as route
from v_ocr_rows where {_ROUTE_TEXT_SQL} <> ''"""))
def q_tag_route(spark, sf):
    """Tagger routing: rows without text are dropped; rejected rows are tagged without a
    model; labels pick the request template; other labels are unroutable."""
    return routed(materialize(_route_rows(spark, sf), "stage-rows")).select("row_id", "route")


_TEMPLATES = {"chyron": "Lower third, name first: {text}", "credits": "Credit roll, role first: {text} -- end"}


@register("q_request", O.with_views(["v_ocr_rows"], f"""
, r as (select row_id, {_ROUTE_TEXT_SQL} as t,
               case when ocr_accepted then coalesce({O.label('scene_code')}, 'unroutable') else 'rejected' end as route
        from v_ocr_rows)
select row_id, case route when 'chyron' then 'Lower third, name first: ' || t
                          when 'credits' then 'Credit roll, role first: ' || t || ' -- end' end as request
from r where t <> ''""".lstrip()))
def q_request(spark, sf):
    """Requests built from the user's template of each route."""
    return with_request(routed(materialize(_route_rows(spark, sf), "stage-rows")), _TEMPLATES).select("row_id", "request")


def _stub_tagger():
    def tag(text: str, label: str) -> str:
        words = text.split()
        head, tail = ("BF:1", "IF:1") if label == "chyron" else ("BR:1", "IR:1")
        return " ".join(f"{w}@{head if i == 0 else tail}" for i, w in enumerate(words))
    return tag


@register("q_tag_apply", O.with_views(["v_ocr_rows"], f"""
, r as (select row_id, case when ocr_accepted then coalesce({O.label('scene_code')}, 'unroutable') else 'rejected' end as route,
               {O.tokens(_ROUTE_TEXT_SQL)} as ws
        from v_ocr_rows where {_ROUTE_TEXT_SQL} <> '')
select row_id, route, case when route in ('chyron', 'credits') then 'ok' else route end as tag_status, null::varchar as tag_error,
  case route when 'unroutable' then null when 'rejected' then array_to_string(list_transform(ws, lambda w: w || '@O'), ' ')
    else array_to_string(list_transform(ws, lambda w, i: w || '@' || (case when i = 1 then 'B' else 'I' end)
      || (case route when 'chyron' then 'F:1' else 'R:1' end)), ' ') end as tagged
from r""".lstrip()))
def q_tag_apply(spark, sf):
    """Tagging through ``mapInPandas`` with a deterministic stand-in model."""
    return annotate(_route_rows(spark, sf), _stub_tagger, max_retries=1, backoff_s=0.0).select(
        "row_id", "route", "tag_status", "tag_error", "tagged")


@register("q_tag_resume", O.with_views(["v_ocr_rows"], f"""
, r as (select row_id, case when ocr_accepted then coalesce({O.label('scene_code')}, 'unroutable') else 'rejected' end as route,
               {O.tokens(_ROUTE_TEXT_SQL)} as ws
        from v_ocr_rows where {_ROUTE_TEXT_SQL} <> '')
, t as (select row_id, route, case when route in ('chyron', 'credits') then 'ok' else route end as tag_status,
  case when route in ('chyron', 'credits') then 1 else 0 end as calls,
  case route when 'unroutable' then null when 'rejected' then array_to_string(list_transform(ws, lambda w: w || '@O'), ' ')
    else array_to_string(list_transform(ws, lambda w, i: w || '@' || (case when i = 1 then 'B' else 'I' end)
      || (case route when 'chyron' then 'F:1' else 'R:1' end)), ' ') end as tagged
  from r)
select * from t""".lstrip()))
def q_tag_resume(spark, sf):
    """Tagging stopped half way and taken up again: equal texts are called once, and nothing is
    called twice."""
    rows, store = materialize(_route_rows(spark, sf), "route-rows"), scratch_path(spark, "tag-store")
    call_pending(rows, _stub_tagger, store, batches=4, stop_after=2)
    call_pending(rows, _stub_tagger, store, batches=4)
    return tagged_rows(rows, store).select("row_id", "route", "tag_status", "calls", "tagged")


# =========================================================================== tagged text
@register("q_verbatim", O.with_views(["v_tagged"], f"""
select doc_id,
       {O.tokens("regexp_replace(tagged, '@.*? |@.*$', ' ', 'g')")} = {O.tokens('cleaned_text')} as verbatim_ok
from v_tagged"""))
def q_verbatim(spark, sf):
    t = V.v_tagged(spark, sf)
    return t.select("doc_id", verbatim_ok("tagged", "cleaned_text").alias("verbatim_ok"))


_TOK_SQL = f"""
, tok0 as materialized (select doc_id, unnest(generate_series(0, len(toks) - 1)) as pos, unnest(toks) as token
           from (select doc_id, {O.tokens('tagged')} as toks from v_tagged))
, tok1 as (select doc_id, pos, token, cast(len(string_split(token, '@')) as bigint) as n_parts,
                  string_split(token, '@')[1] as word,
                  case when len(string_split(token, '@')) = 2 then string_split(token, '@')[2] end as tag
           from tok0)
, tok as (select *, case when tag <> '' then left(tag, 1) end as bio,
                 case when tag <> '' then substr(tag, 2) end as name
          from tok1)"""

_PARSE_SQL = _TOK_SQL + """
, t2 as (select *, coalesce(tag <> 'O' and bio = 'B', false) as is_b,
                   coalesce(tag <> 'O' and bio = 'I', false) as is_i from tok)
, t3 as (select *, max(case when is_b then pos end) over (
             partition by doc_id order by pos rows between unbounded preceding and current row) as phrase_pos,
                   last_value(case when is_b then name end ignore nulls) over (
             partition by doc_id order by pos rows between unbounded preceding and current row) as open_name
         from t2)
, t4 as materialized (select *, coalesce(n_parts <> 2 or tag = '' or (is_i and (open_name is null or open_name <> name)), true) as bad
         from t3)
, ph as materialized (select doc_id, phrase_pos, max(case when is_b then name end) as phrase_tag,
                string_agg(word, ' ' order by pos) as phrase_text
         from t4 where is_b or (is_i and not bad) group by doc_id, phrase_pos)
, bt as (select doc_id, bool_or(bad) as b from t4 group by doc_id)
, bp as (select doc_id, bool_or((contains(phrase_tag, 'R') or contains(phrase_tag, 'F')) and not contains(phrase_tag, ':')) as b
         from ph group by doc_id)
, errs as materialized (select v.doc_id, v.tagged is null or coalesce(bt.b, false) or coalesce(bp.b, false) as parse_error
           from v_tagged v left join bt on bt.doc_id = v.doc_id left join bp on bp.doc_id = v.doc_id)
, okph as materialized (select * from ph where doc_id in (select doc_id from errs where not parse_error))"""

_BIND_SQL = _PARSE_SQL + """
, roles as (select doc_id, phrase_text as role, phrase_pos, string_split(phrase_tag, ':')[2] as ridx,
                   min(phrase_pos) over (partition by doc_id, phrase_text) as role_pos,
                   max(phrase_pos) over (partition by doc_id, phrase_text) as last_pos
            from okph where contains(phrase_tag, 'R'))
, fills as (select doc_id, phrase_tag as ftag, phrase_text as filler, phrase_pos as filler_pos
            from okph where contains(phrase_tag, 'F'))
, bound as (select r.doc_id, r.role, r.role_pos, f.filler, f.filler_pos
            from roles r left join fills f on f.doc_id = r.doc_id and f.ftag = 'F:' || r.ridx
            where r.phrase_pos = r.last_pos)"""


@register("q_bio_tokens", O.with_views(["v_tagged"], _TOK_SQL.lstrip() + """
select doc_id, cast(pos as bigint) as pos, word, tag, bio, string_split(name, ':')[2] as idx from tok"""))
def q_bio_tokens(spark, sf):
    t = bio.explode_tags(V.v_tagged(spark, sf))
    return t.select("doc_id", "pos", "word", "tag", "bio", "idx")


@register("q_bio_errors", O.with_views(["v_tagged"], _PARSE_SQL.lstrip() + """
select doc_id, parse_error from errs"""))
def q_bio_errors(spark, sf):
    return bio.parse_errors(V.v_tagged(spark, sf))


@register("q_bio_phrases", O.with_views(["v_tagged"], _PARSE_SQL.lstrip() + """
select doc_id, cast(phrase_pos as bigint) as phrase_pos, phrase_tag, phrase_text from okph"""))
def q_bio_phrases(spark, sf):
    return bio.phrases(V.v_tagged(spark, sf)).select("doc_id", "phrase_pos", "phrase_tag", "phrase_text")


@register("q_bio_bind", O.with_views(["v_tagged"], _BIND_SQL.lstrip() + """
select doc_id, role, cast(role_pos as bigint) as role_pos, filler, cast(filler_pos as bigint) as filler_pos
from bound"""))
def q_bio_bind(spark, sf):
    bound, _ = bio.bindings(V.v_tagged(spark, sf))
    return bound


@register("q_bio_leftover", O.with_views(["v_tagged"], _BIND_SQL.lstrip() + """
select doc_id, filler, cast(min(filler_pos) as bigint) as filler_pos from fills f
where not exists (select 1 from bound b where b.doc_id = f.doc_id and b.filler = f.filler)
group by doc_id, filler"""))
def q_bio_leftover(spark, sf):
    _, left = bio.bindings(V.v_tagged(spark, sf))
    return left


# =========================================================================== frames
_NAMES_SQL = """
, names as (
  select guid || '.' || cast(frame_num as varchar) || '.png' as name from v_frames
  union all select printf('%s.%010d.png', guid, frame_num) from v_frames where frame_num % 50 < 4
  union all select guid || '.x' || cast(frame_num as varchar) || '.png' from v_frames where frame_num % 97 = 0)
, parsed as (select name, string_split(name, '.')[1] as guid, try_cast(string_split(name, '.')[2] as bigint) as frame_num
  from names)"""


def _frame_names(spark, sf) -> DataFrame:
    """File names of all frames, some of them twice (padded and not), and malformed ones."""
    f = V.v_frames(spark, sf)
    padded = F.format_string("%s.%010d.png", F.col("guid"), F.col("frame_num"))
    names = (f.select(frames.frame_file_name("guid", "frame_num").alias("name"))
             .unionByName(f.filter("frame_num % 50 < 4").select(padded.alias("name")))
             .unionByName(f.filter("frame_num % 97 = 0").select(
                 F.concat("guid", F.lit(".x"), F.col("frame_num").cast("string"), F.lit(".png")).alias("name"))))
    g, n = frames.parse_frame_name("name")
    return names.select("name", g.alias("guid"), n.alias("frame_num"))


@register("q_frame_index", O.with_views(["v_frames"], _NAMES_SQL.lstrip() + """
select row_number() over (order by guid, frame_num, name) - 1 as frame_idx, name, guid, frame_num,
       guid || '.' || cast(frame_num as varchar) as image_id
from parsed where frame_num is not null"""))
def q_frame_index(spark, sf):
    """Frame file names are parsed back to (guid, frame) and given a global 0-based index in
    (guid, frame, name) order; two names of one frame keep a place each."""
    idx = frames.index_frames(_frame_names(spark, sf), ["name"])
    return idx.select("frame_idx", "name", "guid", "frame_num", frames.image_id("guid", "frame_num").alias("image_id"))


@register("q_frame_quarantine", O.with_views(["v_frames"], _NAMES_SQL.lstrip() + """
select name, guid from parsed where frame_num is null"""))
def q_frame_quarantine(spark, sf):
    """File names that give no frame number."""
    return frames.malformed_frames(_frame_names(spark, sf)).select("name", "guid")


@register("q_frames_per_guid", O.with_views(["v_frames"], """
select guid, frame_num, row_number() over (partition by guid order by frame_num) - 1 as frame_ord,
       count(*) over (partition by guid) as n_frames
from v_frames"""))
def q_frames_per_guid(spark, sf):
    return frames.frames_in_guid(V.v_frames(spark, sf)).select("guid", "frame_num", "frame_ord", "n_frames")


@register("q_frame_time", O.with_views(["v_frames"], """
, s as (select guid, frame_num, frame_num // 30 as secs from v_frames)
, p as (select *, secs // 86400 as d, secs % 86400 as rem from s)
select guid, frame_num,
       case when d = 0 then printf('%d:%02d:%02d', rem // 3600, (rem % 3600) // 60, rem % 60)
            else printf('%d %s, %d:%02d:%02d', d, case when d = 1 then 'day' else 'days' end,
                        rem // 3600, (rem % 3600) // 60, rem % 60) end as offset_hms,
       replace(guid, 'cpb-aacip-', 'cpb-aacip_') as catalog_key
from p""".lstrip()))
def q_frame_time(spark, sf):
    f = V.v_frames(spark, sf)
    return f.select("guid", "frame_num", frames.frame_hms("frame_num").alias("offset_hms"),
                    frames.catalog_key("guid").alias("catalog_key"))


@register("q_frame_sampling", O.with_views(["v_timeframes"], """
select distinct guid, frame_num, printf('%s.%04d.png', guid, frame_num) as frame_name
from (select guid, unnest(range(start_frame, end_frame, 15)) as frame_num from v_timeframes)"""))
def q_frame_sampling(spark, sf):
    s = frames.sample_frames(V.v_timeframes(spark, sf))
    return s.withColumn("frame_name", frames.padded_frame_name("guid", "frame_num"))


@register("q_progress", O.with_views(["v_frames"], """
, t as (select guid, count(*) as n_total from v_frames group by guid)
, d as (select guid, count(*) as n_done from v_frames where annotated group by guid)
select coalesce(t.guid, d.guid) as guid, coalesce(n_done, 0) as n_done, coalesce(n_total, 0) as n_total,
       cast(coalesce(n_done, 0) as varchar) || '/' || cast(coalesce(n_total, 0) as varchar) as progress
from t full outer join d on t.guid = d.guid""".lstrip()))
def q_progress(spark, sf):
    f = V.v_frames(spark, sf)
    return frames.progress(f, f.filter("annotated"))


@register("q_done_frames", O.with_views(["v_frames"], """
select guid, frame_num from v_frames f
where exists (select 1 from v_frames a where a.annotated and a.guid = f.guid and a.frame_num = f.frame_num)"""))
def q_done_frames(spark, sf):
    f = V.v_frames(spark, sf)
    return frames.done_frames(f, f.filter("annotated")).select("guid", "frame_num")


@register("q_todo_frames", O.with_views(["v_frames"], """
select guid, frame_num from v_frames f
where not exists (select 1 from v_frames a where a.annotated and a.guid = f.guid and a.frame_num = f.frame_num)"""))
def q_todo_frames(spark, sf):
    f = V.v_frames(spark, sf)
    return frames.todo_frames(f, f.filter("annotated")).select("guid", "frame_num")


@register("q_next_todo", O.with_views(["v_frames"], """
select guid, coalesce(min(frame_num) filter (where not annotated), max(frame_num)) as next_frame,
       count(*) as n_total, count(*) filter (where not annotated) as n_todo,
       min(frame_num) filter (where not annotated) is null as all_done
from v_frames group by guid"""))
def q_next_todo(spark, sf):
    return frames.next_todo(V.v_frames(spark, sf))


@register("q_row_lookup", O.with_views(["v_frames"], """
, idx as (select row_number() over (order by guid, frame_num) - 1 as frame_idx, guid, frame_num from v_frames)
, req as (select event_id as req_id, event_id * 7 - 1000 as req_idx from events)
select req_id, frame_idx, guid, frame_num from req join idx on req.req_idx = idx.frame_idx""".lstrip()))
def q_row_lookup(spark, sf):
    """Bounds-checked jumps: each request names a global frame index; indexes outside
    [0, n) return nothing."""
    idx = frames.index_frames(V.v_frames(spark, sf).select("guid", "frame_num"))
    req = V.table(spark, sf, "events").select(
        F.col("event_id").alias("req_id"), (F.col("event_id") * 7 - 1000).alias("req_idx"))
    return frames.lookup_rows(idx, req).select("req_id", "frame_idx", "guid", "frame_num")


_PREV_W = "partition by guid order by frame_num rows between unbounded preceding and 1 preceding"


@register("q_prev_asof", O.with_views(["v_frames"], f"""
, p as (select guid, frame_num,
               max(frame_num) over ({_PREV_W}) is null as is_first,
               max(case when annotated and skip_reason is null then frame_num end) over ({_PREV_W}) as prev_frame
        from v_frames)
select p.guid, p.frame_num, p.is_first, p.prev_frame, f.role as prev_role
from p left join v_frames f on f.guid = p.guid and f.frame_num = p.prev_frame""".lstrip()))
def q_prev_asof(spark, sf):
    out = frames.copy_previous(V.v_frames(spark, sf))
    return out.select("guid", "frame_num", "is_first", "prev_frame", "prev_role")


@register("q_prev_overlay", O.with_views(["v_frames"], f"""
, p as (select guid, frame_num, role,
               max(case when annotated and skip_reason is null then frame_num end) over ({_PREV_W}) as prev_frame
        from v_frames)
, r as (select p.guid, p.frame_num, p.role as now, f.role as old, p.prev_frame
        from p left join v_frames f on f.guid = p.guid and f.frame_num = p.prev_frame)
, m as (select guid, frame_num, 'all' as role, 'of ' || coalesce(prev_frame, frame_num) as filler from r
        union all select guid, frame_num, now, 'own ' || frame_num from r where old is null or old <> now
        union all select guid, frame_num, old, 'own ' || prev_frame from r where old is not null)
select guid, frame_num, string_agg(role || '=' || filler, ';' order by role) as bindings from m group by guid, frame_num""".lstrip()))
def q_prev_overlay(spark, sf):
    """The copied frame's roles written over the current map: equal roles are replaced, the
    others stay, keys that are no roles are not copied."""
    f = V.v_frames(spark, sf)
    one = lambda prefix: F.array(F.concat(F.lit(prefix), F.col("frame_num").cast("string")))
    f = f.withColumn("bindings", F.create_map(F.lit("all"), one("of "), F.col("role"), one("own "), F.lit("_image_id"), one("")))
    out = frames.copy_previous_bindings(f)
    entries = F.array_sort(F.filter(F.map_entries("copied"), lambda e: e["key"] != "_image_id"))
    return out.select("guid", "frame_num", F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("bindings"))


@register("q_dup_resolve", O.with_views(["v_frames"], f"""
, p as (select guid, frame_num, skip_reason,
               max(case when annotated and skip_reason is null then frame_num end)
                   over ({_PREV_W}) as source_frame
        from v_frames)
select p.guid, p.frame_num, p.source_frame, f.role as source_role
from p left join v_frames f on f.guid = p.guid and f.frame_num = p.source_frame
where p.skip_reason = 'DUPLICATE'""".lstrip()))
def q_dup_resolve(spark, sf):
    out = frames.resolve_duplicates(V.v_frames(spark, sf))
    return out.select("guid", "frame_num", "source_frame", "source_role")


@register("q_chain", O.with_views(["v_credits"], """
, c as (select guid, frame_num, continuing,
               max(case when not continuing then frame_num end) over (
                   partition by guid order by frame_num rows between unbounded preceding and current row) as chain_start
        from v_credits)
select guid, frame_num, chain_start, case when continuing then chain_start end as continued_from from c""".lstrip()))
def q_chain(spark, sf):
    return frames.chains(V.v_credits(spark, sf)).select("guid", "frame_num", "chain_start", "continued_from")


@register("q_chain_bindings", O.with_views(["v_credits"], """
, c as (select guid, frame_num, role, filler,
               max(case when not continuing then frame_num end) over (
                   partition by guid order by frame_num rows between unbounded preceding and current row) as chain_start
        from v_credits)
select guid, chain_start, row_number() over (partition by guid, chain_start order by frame_num) - 1 as place,
       frame_num, role, filler from c where chain_start is not null""".lstrip()))
def q_chain_bindings(spark, sf):
    """The bindings of each continuation chain, one after the other."""
    return frames.chain_bindings(frames.chains(V.v_credits(spark, sf))).select(
        "guid", "chain_start", "place", "frame_num", "role", "filler")


def _pair_log(spark, sf) -> DataFrame:
    """A pair log per frame: eight turns of a conversation make up one frame's log."""
    c = V.v_credits(spark, sf)
    return c.select(
        "guid", F.floor(F.col("frame_num") / 8).alias("frame"), F.col("frame_num").alias("seq"),
        F.when(F.col("frame_num") % 7 == 6, "delete").otherwise("add").alias("action"), "role",
        F.when(F.col("frame_num") % 5 == 4, F.lit("")).otherwise(F.col("filler")).alias("fillers"))


@register("q_pair_fold", O.with_views(["v_credits"], f"""
, ev as (select guid, frame_num // 8 as frame, frame_num as seq,
                case when frame_num % 7 = 6 then 'delete' else 'add' end as action, role,
                case when frame_num % 5 = 4 then '' else filler end as fillers from v_credits)
, ev2 as (select * from ev where not (action = 'add' and role = '' and coalesce(fillers, '') = ''))
, st as (select guid, frame, role,
                max(case when action = 'delete' or (action = 'add' and coalesce(fillers, '') = '') then seq end) as rs,
                max(case when action = 'delete' then seq end) as dl,
                max(case when action = 'add' then seq end) as ad
         from ev2 group by guid, frame, role)
, alive as (select * from st where ad is not null and (dl is null or ad > dl))
, pieces as (select guid, frame, role, seq, unnest(generate_series(0, len(p) - 1)) as piece, unnest(p) as filler
             from (select guid, frame, role, seq, list_transform(string_split(fillers, chr(10)), lambda x: {O.strip('x')}) as p
                   from ev2 where action = 'add' and coalesce(fillers, '') <> ''))
, kept as (select p.* from pieces p join alive a on a.guid = p.guid and a.frame = p.frame and a.role = p.role
           where a.rs is null or p.seq > a.rs)
select guid, frame, role, seq, cast(piece as bigint) as piece, filler from kept
union all
select guid, frame, role, null, null, null from alive a
where not exists (select 1 from kept k where k.guid = a.guid and k.frame = a.frame and k.role = a.role)""".lstrip()))
def q_pair_fold(spark, sf):
    """Role -> fillers bindings of each frame folded from an add/reset/delete pair log."""
    return frames.fold_pairs(_pair_log(spark, sf), ["guid", "frame"])


@register("q_autofill", O.with_views(["v_credits"], """
, c as (select guid, frame_num, case when role = 'user' then 'role' else 'fillers' end as slot, string_split(filler, ' ') as w
        from v_credits)
, e as (select guid, frame_num, slot, unnest(generate_series(1, len(w))) as n, unnest(w) as word from c)
, f as (select guid, frame_num, slot, min(n) filter (where word <> '') as first_word from e group by guid, frame_num, slot)
select f.guid, f.frame_num, f.slot,
       coalesce(string_agg(e.word, ' ' order by e.n) filter (where e.n >= f.first_word), '') as value
from f join e using (guid, frame_num, slot) group by f.guid, f.frame_num, f.slot""".lstrip()))
def q_autofill(spark, sf):
    """Clicked words appended to a frame's slot, in click order."""
    c = V.v_credits(spark, sf).select(
        "guid", "frame_num", F.when(F.col("role") == "user", "role").otherwise("fillers").alias("slot"),
        F.posexplode(F.split("filler", " ")).alias("click", "text"))
    return frames.autofill(c, ["guid", "frame_num", "slot"], "click", "text")


@register("q_last_write", O.with_views(["v_review_events"], """
select row_id, max(seq) as seq, arg_max(action, seq) as action from v_review_events group by row_id"""))
def q_last_write(spark, sf):
    ev = V.v_review_events(spark, sf)
    return frames.last_write(ev, "row_id", "seq", ["action"])


@register("q_gold_parse", O.with_views(["v_credits"], f"""
, g as (select guid, frame_num, role, list_transform(string_split(filler, chr(10)), lambda x: {O.strip('x')}) as p,
               cast(guid as varchar) || '.' || cast(frame_num as varchar) as image_id
        from v_credits)
select guid, frame_num, role, unnest(generate_series(0, len(p) - 1)) as filler_ord, unnest(p) as filler, image_id
from g""".lstrip()))
def q_gold_parse(spark, sf):
    """Gold annotation records: encoded as flat JSON (role keys + ``_`` meta keys),
    written, scanned, parsed back; guid and frame come from ``_image_id``."""
    c = frames.chains(V.v_credits(spark, sf))
    meta = F.map_concat(
        F.create_map(F.lit("_image_id"), frames.image_id("guid", "frame_num")),
        F.when(F.col("continuing") & F.col("chain_start").isNotNull(),
               F.create_map(F.lit("_continued_from"), frames.image_id("guid", "chain_start")))
         .otherwise(F.create_map().cast("map<string,string>")))
    binding = F.create_map(F.col("role"), split_lines_stripped("filler"))
    path = scratch_path(spark, "gold")
    c.select(AJ.encode_gold(binding, meta).alias("value")).write.text(path)
    m_b, m_meta = AJ.parse_gold(F.col("value"))
    parsed = spark.read.text(path).select(m_b.alias("b"), m_meta.alias("meta"))
    img = F.col("meta")["_image_id"]
    ex = parsed.select(img.alias("image_id"), F.explode("b").alias("role", "fillers"))
    out = ex.select("image_id", "role", F.posexplode("fillers").alias("filler_ord", "filler"))
    g, n = frames.parse_frame_name("image_id")
    return out.select(g.cast("long").alias("guid"), n.alias("frame_num"), "role",
                      F.col("filler_ord").cast("long"), "filler", "image_id")


@register("q_gold_scan", O.with_views(["v_frames"], f"""
, p as (select guid, frame_num, role, skip_reason, annotated,
               max(case when annotated and skip_reason is null then frame_num end) over ({_PREV_W}) as chain_start from v_frames)
select guid, frame_num, guid || '.' || frame_num as image_id,
       case when skip_reason is null and chain_start is not null then guid || '.' || chain_start end as continued_from, skip_reason,
       case when skip_reason is null then role || '=' || 'a ' || frame_num || '|b' end as bindings
from p where annotated""".lstrip()))
def q_gold_scan(spark, sf):
    """Gold records saved twice (the later save wins), read back from JSON Lines: roles with
    lists of fillers, continuations, skipped frames."""
    path = scratch_path(spark, "gold-lines")
    AJ.write_gold(_gold_records(spark, sf), path)
    return _gold_view(AJ.read_gold(spark, path))


def _gold_records(spark, sf) -> DataFrame:
    f = frames.copy_previous(V.v_frames(spark, sf)).filter("annotated")
    image = frames.image_id("guid", "frame_num")
    meta = F.map_filter(F.create_map(
        F.lit("_image_id"), image, F.lit("_skip_reason"), F.col("skip_reason"), F.lit("_continued_from"),
        F.when(F.col("skip_reason").isNull() & F.col("prev_frame").isNotNull(), frames.image_id("guid", "prev_frame"))),
        lambda k, v: v.isNotNull())
    roles = F.when(F.col("skip_reason").isNull(), F.create_map(
        F.col("role"), F.array(F.concat(F.lit("a "), F.col("frame_num").cast("string")), F.lit("b")))).otherwise(
        F.create_map().cast("map<string,array<string>>"))
    saved = f.select("guid", "frame_num", F.lit(2).alias("seq"), roles.alias("bindings"), meta.alias("meta"))
    early = saved.withColumn("seq", F.lit(1)).withColumn("bindings", F.create_map(F.lit("old"), F.array(F.lit("x"))))
    return saved.unionByName(early).select("guid", "frame_num", "seq", "bindings", F.col("meta"))


def _gold_view(gold: DataFrame) -> DataFrame:
    pairs = F.transform(F.map_entries("bindings"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))
    return gold.select("guid", "frame_num", "image_id", "continued_from", "skip_reason",
                       F.when(F.size("bindings") > 0, F.array_join(pairs, ";")).alias("bindings"))


@register("q_gold_quarantine", O.with_views(["v_credits"], """
select cast(guid as varchar) || '.' || frame_num as image_id,
       case frame_num % 4 when 1 then 'no JSON object' when 2 then 'wrong kind: ' || role when 3 then 'wrong kind: _note' end as fault
from v_credits"""))
def q_gold_quarantine(spark, sf):
    """Gold records as text, some cut off, some with a role that is no list or a meta key that is no
    string: each is told with its reason."""
    c = V.v_credits(spark, sf)
    image = F.concat(F.col("guid").cast("string"), F.lit("."), F.col("frame_num").cast("string"))
    text, names = F.to_json(F.array("filler")), F.concat(F.lit('","_note":"'), image, F.lit('"}'))
    role = F.when(F.col("frame_num") % 4 == 2, F.lit('"one"')).otherwise(text)
    head = F.concat(F.lit('{"'), F.col("role"), F.lit('":'), role, F.lit(',"_image_id":"'), image)
    value = (F.when(F.col("frame_num") % 4 == 1, F.concat(F.lit('"'), F.col("role")))
             .when(F.col("frame_num") % 4 == 3, F.concat(head, F.lit('","_note":["x"]}'))).otherwise(F.concat(head, names)))
    path = scratch_path(spark, "gold-bad")
    c.select(image.alias("image_id"), value.alias("value")).write.parquet(path)
    return spark.read.parquet(path).select("image_id", AJ.gold_faults(F.col("value")).alias("fault"))


@register("q_gold_upsert", O.with_views(["v_frames"], f"""
, p as (select guid, frame_num, role, skip_reason, annotated,
               max(case when annotated and skip_reason is null then frame_num end) over ({_PREV_W}) as chain_start from v_frames)
select guid, frame_num, guid || '.' || frame_num as image_id,
       case when skip_reason is null and chain_start is not null then guid || '.' || chain_start end as continued_from, skip_reason,
       case when skip_reason is null then role || '=' || 'a ' || frame_num || '|b' end as bindings
from p where annotated""".lstrip()))
def q_gold_upsert(spark, sf):
    """Gold saves merged into a snapshot in three batches: early saves, the later saves of one half of
    the frames, of the other half; only the buckets a batch touches are rewritten."""
    path, saves = scratch_path(spark, "gold-store"), materialize(_gold_records(spark, sf), "gold-saves")
    half = F.pmod("frame_num", F.lit(2)) == 0
    for batch in (saves.filter("seq = 1"), saves.filter((F.col("seq") == 2) & half), saves.filter((F.col("seq") == 2) & ~half)):
        gold_store.upsert(batch, path, buckets=32)
    return _gold_view(gold_store.gold_rows(gold_store.read_snapshot(spark, path)))


@register("q_gold_files", O.with_views(["v_credits"], f"""
select cast(guid as varchar) as guid, frame_num, cast(guid as varchar) || '.' || frame_num as image_id,
       role || '=' || array_to_string(list_transform(string_split(filler, chr(10)), lambda x: {O.strip('x')}), '|') as bindings
from v_credits"""))
def q_gold_files(spark, sf):
    """A flat folder with one indented gold record per frame, read back; guid and frame come from the
    file names."""
    c = V.v_credits(spark, sf)
    folder = scratch_path(spark, "gold-files")
    AJ.write_gold_files(c.select(F.col("guid").cast("string").alias("guid"), "frame_num", F.lit(1).alias("seq"),
                                 F.create_map("role", split_lines_stripped("filler")).alias("bindings"),
                                 F.create_map(F.lit("_image_id"), frames.image_id("guid", "frame_num")).alias("meta")), folder)
    return _gold_view(AJ.read_gold_files(spark, folder)).select("guid", "frame_num", "image_id", "bindings")


# =========================================================================== frame images
def _page_frames(spark, sf) -> str:
    """Every page's html as the bytes of a frame image file."""
    folder = scratch_path(spark, "frames")
    p = V.table(spark, sf, "pages")
    write_frames(p.select(F.concat(F.lit("cpb-aacip-src"), (F.col("page_id") % 15).cast("string")).alias("guid"),
                          F.col("page_id").alias("frame_num"), F.col("html").cast("binary").alias("content")), folder)
    return folder


_PAGE_FRAMES_SQL = """
with f as (select 'cpb-aacip-src' || (page_id % 15) as guid, page_id as frame_num, html from pages where html is not null)"""


@register("q_frame_listing", _PAGE_FRAMES_SQL + """
select guid, frame_num, guid || '.' || frame_num || '.png' as name, strlen(html) as length,
       row_number() over (order by guid, frame_num) - 1 as frame_idx from f""")
def q_frame_listing(spark, sf):
    """A folder of frame images listed without reading their bytes; guid, frame and the global
    index come from the names."""
    listed = list_frames(spark, _page_frames(spark, sf))
    named = listed.select("guid", "frame_num", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return frames.index_frames(named).select("guid", "frame_num", "name", "length", "frame_idx")


def _stub_ocr():
    """A byte model: a box per line that holds a letter or digit, as wide as the line has bytes."""
    def read(content: bytes) -> list:
        out = []
        for y, line in enumerate(content.split(b"\n")):
            if any(c.isalnum() for c in line.decode()):
                w = len(line)
                out.append(([(0, y), (w, y), (w, y + 1), (0, y + 1)], line.decode(), w % 100 / 100))
        return out
    return read


@register("q_ocr_frames", _PAGE_FRAMES_SQL + r"""
, l as (select guid, frame_num, unnest(range(0, len(ls))) as y, unnest(ls) as text
        from (select *, string_split(html, chr(10)) as ls from f))
, b as (select *, strlen(text) as w, (strlen(text) % 100)::double / 100 as confidence from l where regexp_matches(text, '[\p{L}\p{N}]'))
select guid, frame_num, row_number() over (partition by guid, frame_num order by y) - 1 as box_pos, text, confidence,
       case when confidence > 0.8 then 'high' when confidence > 0.5 then 'medium' else 'low' end as tier,
       0::bigint as x0, y as y0, w as x2, y + 1 as y2 from b""")
def q_ocr_frames(spark, sf):
    """Frame images read as binary files, run through a byte model, exploded to boxes with their
    tier and corners."""
    found = ocr_frames(list_frames(spark, _page_frames(spark, sf), with_content=True), _stub_ocr)
    cs = boxes.corners("bbox")
    return boxes.explode_boxes(found).select(
        "guid", "frame_num", "box_pos", "text", "confidence", boxes.confidence_tier("confidence").alias("tier"),
        *[cs[k].cast("long").alias(k) for k in ("x0", "y0", "x2", "y2")])


# =========================================================================== boxes
@register("q_conf_tier", O.with_views(["v_box"], """
select guid, frame_num, box_idx,
       case when isnan(confidence) then 'low' when confidence > 0.8 then 'high'
            when confidence > 0.5 then 'medium' else 'low' end as tier
from v_box"""))
def q_conf_tier(spark, sf):
    b = V.v_box(spark, sf)
    return b.select("guid", "frame_num", "box_idx", boxes.confidence_tier("confidence").alias("tier"))


@register("q_box_geom", O.with_views(["v_box"], """
select guid, frame_num, box_idx, cast(trunc(x0) as bigint) as x0, cast(trunc(y0) as bigint) as y0,
       cast(trunc(x1) as bigint) as x2, cast(trunc(y1) as bigint) as y2
from v_box"""))
def q_box_geom(spark, sf):
    b = V.v_box(spark, sf).withColumn("bbox", boxes.rect_bbox("x0", "y0", "x1", "y1"))
    cs = boxes.corners("bbox")
    return b.select("guid", "frame_num", "box_idx", *[cs[k].cast("long").alias(k) for k in ("x0", "y0", "x2", "y2")])


@register("q_box_explode", O.with_views(["v_box"], """
select guid, frame_num, row_number() over (partition by guid, frame_num order by box_idx, x0, y0, y1) - 1 as box_pos,
       'box ' || box_idx as text, x0, y1 from v_box"""))
def q_box_explode(spark, sf):
    """Box arrays per frame, exploded to one row per box with its display number."""
    b = V.v_box(spark, sf).withColumn("bbox", boxes.rect_bbox("x0", "y0", "x1", "y1"))
    one = F.struct("box_idx", "x0", "y0", "y1", F.struct(
        "bbox", F.concat(F.lit("box "), F.col("box_idx").cast("string")).alias("text"), "confidence").alias("box"))
    per = b.groupBy("guid", "frame_num").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["box"]).alias("boxes"))
    return boxes.explode_boxes(per).select("guid", "frame_num", "box_pos", "text", F.col("bbox")[0]["x"].alias("x0"),
                                           F.col("bbox")[2]["y"].alias("y1"))


@register("q_box_join", O.with_views(["v_box"], """
, f as (select distinct l_orderkey as guid, cast(l_linenumber as bigint) as frame_num from lineitem)
select f.guid, f.frame_num, b.box_idx, b.x0
from f join v_box b on b.guid = f.guid and b.frame_num = f.frame_num""".lstrip()))
def q_box_join(spark, sf):
    """OCR boxes stored as a Parquet table clustered by (guid, frame), then joined with the
    frames that need them."""
    path = scratch_path(spark, "boxes")
    boxes.write_boxes(V.v_box(spark, sf), path)
    stored = spark.read.parquet(path)
    f = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("guid"), F.col("l_linenumber").cast("long").alias("frame_num")).distinct()
    return boxes.boxes_for_frames(f, stored).select("guid", "frame_num", "box_idx", "x0")


@register("q_box_bucketed", ORACLE["q_box_join"])
def q_box_bucketed(spark, sf):
    """Boxes and frames as tables bucketed by (guid, frame): their join moves neither."""
    f = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("guid"), F.col("l_linenumber").cast("long").alias("frame_num")).distinct()
    run = uuid.uuid4().hex
    a, b = (boxes.write_bucketed(df, f"{name}_{run}", scratch_path(spark, f"bucketed-{name}"), 16)
            for name, df in (("frames", f), ("boxes", V.v_box(spark, sf))))
    return boxes.boxes_for_frames(a, b).select("guid", "frame_num", "box_idx", "x0")


# =========================================================================== streams
_EVENT_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("seq", T.LongType()),
                              T.StructField("action", T.StringType()), T.StructField("payload", T.StringType())])


def _event_drops(spark, sf, view=None):
    """Write an action log as two file drops plus a hidden folder that must never be read.
    The second drop holds later events, but also earlier ones that come late, and some of the
    first drop again. Returns the base folder and the second drop (written by the caller
    between passes)."""
    base = scratch_path(spark, "drops")
    ev = (view or V.v_review_events)(spark, sf)
    payload = F.col("payload") if "payload" in ev.columns else F.lit(None).cast("string")
    ev = ev.select("row_id", "seq", "action", payload.alias("payload"))
    cutoff = ev.agg(F.percentile_approx("seq", 0.5)).first()[0]
    first = (F.col("seq") <= F.lit(cutoff)) != (F.pmod("seq", F.lit(5)) == 0)
    ev.filter(first).write.parquet(os.path.join(base, "src", "drop1"))
    ev.filter(first).write.parquet(os.path.join(base, "src", ".hidden"))
    return base, ev.filter(~first), ev.filter(first & (F.pmod("seq", F.lit(7)) == 0))


def _stream_fold(spark, sf, view, fold, cols):
    """Run a stateful fold over the two drops of a log (one availableNow pass per drop);
    updates land in a Parquet table per batch, the latest update per row is the state."""
    base, rest, again = _event_drops(spark, sf, view)
    src, sink, ckpt = (os.path.join(base, x) for x in ("src", "sink", "ckpt"))

    def write(batch_df, batch_id):
        batch_df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink)

    def run():
        stream = (spark.readStream.schema(_EVENT_SCHEMA).option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", "*.parquet").parquet(src))
        q = (fold(stream).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    rest.unionByName(again).write.parquet(os.path.join(src, "drop2"))
    run()
    return frames.last_write(spark.read.parquet(sink), "row_id", "batch_id", cols).select("row_id", *cols)


@register("q_incremental", O.with_views(["v_review_events"], """
select row_id, seq, action from v_review_events"""))
def q_incremental(spark, sf):
    """Stage hop over arriving files: two passes of an ``availableNow`` file stream with a
    checkpoint; the second pass reads only the new drop, hidden files are never read."""
    base, rest, _ = _event_drops(spark, sf)
    src, sink, ckpt = (os.path.join(base, x) for x in ("src", "sink", "ckpt"))
    stage_hop(spark, src, _EVENT_SCHEMA, sink, ckpt)
    rest.write.parquet(os.path.join(src, "drop2"))
    stage_hop(spark, src, _EVENT_SCHEMA, sink, ckpt)
    return spark.read.parquet(sink).select("row_id", "seq", "action")


@register("q_review_stream", O.with_views(["v_review_events"], _REVIEW_FOLD_SQL.lstrip() + """
select * from fold"""))
def q_review_stream(spark, sf):
    """The review fold as a stateful stream (``applyInPandasWithState``) over two drops of
    the log."""
    return _stream_fold(spark, sf, V.v_review_events, review_state_stream,
                        ["label_adjusted", "deleted", "annotated", "ocr_accepted"])


@register("q_adjudicate_stream", O.with_views(["v_adjudication_events"], """
select row_id,
       coalesce(arg_max(action, seq) filter (where action in ('accept','reject','edit','undo'))
                in ('accept', 'reject'), false) as adjudicated,
       coalesce(arg_max(action, seq) filter (where action in ('accept','reject','edit','undo'))
                = 'accept', false) as accepted,
       count(*) filter (where action = 'edit') as n_edits,
       arg_max(payload, seq) filter (where action = 'edit' and payload is not null) as edited
from v_adjudication_events group by row_id"""))
def q_adjudicate_stream(spark, sf):
    """The adjudication fold as a stateful stream over two drops of the log."""
    return _stream_fold(spark, sf, V.v_adjudication_events, adjudication_state_stream,
                        ["adjudicated", "accepted", "n_edits", "edited"])


# Deliveries of a log in three drops: every fifth event a drop late, every 97th in the last drop however
# old it is, every seventh twice. The allowed lateness is three eighths of the log.
_DELIVERIES_SQL = """
, top as (select max(seq) + 1 as m from {view})
, came as (select e.*, case when seq % 97 = 0 then 2 else least(2, seq * 3 // m + case when seq % 5 = 0 then 1 else 0 end) end as drop_no
           from {view} e, top)
, deliveries as (select * from came union all select * replace (least(2, drop_no + 1) as drop_no) from came where seq % 7 = 0)
, marks as (select drop_no, max(max(seq)) over (order by drop_no rows between unbounded preceding and 1 preceding) - m * 3 // 8 as mark
            from deliveries, top group by drop_no, m)
, timed as (select d.*, coalesce(mark > 0 and seq <= mark, false) as late from deliveries d join marks using (drop_no))
, in_time as (select distinct * exclude (drop_no, late) from timed where not late)
, n_late as (select row_id, count(*) filter (where late) as n_late from timed group by row_id)"""


def _bounded_fold(spark, sf, view, fold):
    """Deliver a log in three drops, one ``availableNow`` pass each, to a fold with bounded state;
    the updates land in a Parquet table. Timers wait for the next drop (no empty batches between)."""
    base = scratch_path(spark, "bounded")
    ev = view(spark, sf)
    payload = F.col("payload") if "payload" in ev.columns else F.lit(None).cast("string")
    ev = ev.select("row_id", "seq", "action", payload.alias("payload"))
    m = ev.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
    seq = F.col("seq")
    drop = F.when(seq % 97 == 0, 2).otherwise(F.least(F.lit(2), F.floor(seq * 3 / m) + (seq % 5 == 0).cast("int"))).cast("int")
    came = ev.withColumn("drop_no", drop)
    again = came.filter(seq % 7 == 0).withColumn("drop_no", F.least(F.lit(2), F.col("drop_no") + 1))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for i in range(3):
        came.unionByName(again).filter(F.col("drop_no") == i).drop("drop_no").write.parquet(f"{base}/src/drop{i}")
        stream = (spark.readStream.schema(_EVENT_SCHEMA).option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", "*.parquet").parquet(f"{base}/src"))
        q = (fold(stream, m * 3 // 8).writeStream.outputMode("update").option("checkpointLocation", f"{base}/ckpt")
             .foreachBatch(lambda df, b: df.withColumn("batch_id", F.lit(b)).write.mode("append").parquet(f"{base}/sink"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.read.parquet(f"{base}/sink")


@register("q_review_bounded", O.with_views(["v_review_events"], _DELIVERIES_SQL.format(view="v_review_events").lstrip()
          + _REVIEW_FOLD_SQL.replace("from v_review_events", "from in_time") + """
select row_id, coalesce(label_adjusted, false) as label_adjusted, coalesce(deleted, false) as deleted, coalesce(annotated, false) as annotated,
       coalesce(ocr_accepted, false) as ocr_accepted, n_late
from n_late left join fold using (row_id)"""))
def q_review_bounded(spark, sf):
    """The review fold with bounded state: late events within the watermark's delay count, later
    ones change nothing and are counted."""
    cols = ["label_adjusted", "deleted", "annotated", "ocr_accepted", "n_late"]
    out = _bounded_fold(spark, sf, V.v_review_events, review_state_bounded)
    return frames.last_write(out, "row_id", "batch_id", cols).select("row_id", *cols)


@register("q_adjudicate_bounded", O.with_views(["v_adjudication_events"],
          _DELIVERIES_SQL.format(view="v_adjudication_events").lstrip() + """
, fold as (select row_id,
       coalesce(arg_max(action, seq) filter (where action in ('accept','reject','edit','undo')) in ('accept', 'reject'), false) as adjudicated,
       coalesce(arg_max(action, seq) filter (where action in ('accept','reject','edit','undo')) = 'accept', false) as accepted,
       count(*) filter (where action = 'edit') as n_edits,
       arg_max(payload, seq) filter (where action = 'edit' and payload is not null) as edited
  from in_time group by row_id)
select row_id, coalesce(adjudicated, false) as adjudicated, coalesce(accepted, false) as accepted, coalesce(n_edits, 0) as n_edits,
       edited, n_late
from n_late left join fold using (row_id)"""))
def q_adjudicate_bounded(spark, sf):
    """The adjudication fold with bounded state."""
    cols = ["adjudicated", "accepted", "n_edits", "edited", "n_late"]
    out = _bounded_fold(spark, sf, V.v_adjudication_events, adjudication_state_bounded)
    return frames.last_write(out, "row_id", "batch_id", cols).select("row_id", *cols)


@register("q_resume_point", O.with_views(["v_frames"], """
, idx as (select row_number() over (order by guid, frame_num) - 1 as frame_idx, guid, frame_num, annotated
          from v_frames)
select coalesce(min(frame_idx) filter (where not annotated), max(frame_idx)) as frame_idx,
       count(*) as n_frames, min(frame_idx) filter (where not annotated) is null as all_done
from idx""".lstrip()))
def q_resume_point(spark, sf):
    """Where annotation resumes: the first frame (global index order) without an
    annotation, else the last frame."""
    idx = frames.index_frames(V.v_frames(spark, sf).select("guid", "frame_num", "annotated"))
    return idx.agg(
        F.coalesce(F.min(F.when(~F.col("annotated"), F.col("frame_idx"))), F.max("frame_idx")).alias("frame_idx"),
        F.count(F.lit(1)).cast("long").alias("n_frames"),
        F.min(F.when(~F.col("annotated"), F.col("frame_idx"))).isNull().alias("all_done"))


# =========================================================================== composite flows
@register("q_pip_batch", f"""
with d as (select doc_id, text, n_chars,
                  [cast(n_chars % 7 as double)/10.0, cast(doc_id % 4 as double)/10.0,
                   cast(n_chars % 5 as double)/10.0, cast(n_chars % 3 as double)/10.0] as s
           , source from documents where doc_id % 5 <> 0 and doc_id % 7 <> 0)
, r as (select doc_id, 'cpb-aacip-' || source as guid, doc_id * 1000 as time_point,
               ['I','N','C','S'][list_position(s, list_max(s))] as scene_code, list_max(s) as confidence,
               {O.strip("case when doc_id % 3 = 0 then text else '[v2] ' || text end")} as textdocument from d)
, i as (select row_number() over (order by doc_id) - 1 as row_id, *, {O.label('scene_code')} as scene_label from r
        where {O.label('scene_code')} is not null)
select row_id, guid, time_point, scene_label, confidence, textdocument from i
where row_id in (select min(row_id) from i group by textdocument)""")
def q_pip_batch(spark, sf):
    """Batch building from annotation JSON: of rows with equal text the first stays, with all its
    fields."""
    path = scratch_path(spark, "json")
    _annotation_json(spark, sf).repartitionByRange("doc_key").sortWithinPartitions("doc_key").select("value").write.text(path)
    return flows.build_batch(spark, path, one_per_file=False)


_PIP_REVIEW_SQL = _REVIEW_FOLD_SQL + f"""
, p as ({_PATHS_SQL})
, rv as (select m.row_id, p.path, coalesce(f.ocr_accepted, m.ocr_accepted) as ocr_accepted,
       case when f.label_adjusted then (case when m.scene_label = 'chyron' then 'credits' else 'chyron' end)
            else m.scene_label end as scene_label,
       {O.clean('textdocument')} as cleaned_text
from v_mapped m join p using (guid) left join fold f on m.row_id = f.row_id
where coalesce(f.deleted, m.deleted) = false)"""


def _pip_reviewed(spark, sf) -> DataFrame:
    return flows.review_batch(_mapped(spark, sf), V.v_path_rows(spark, sf), V.v_review_events(spark, sf))


@register("q_pip_review", O.with_views(["v_mapped", "v_path_rows", "v_review_events"], _PIP_REVIEW_SQL.lstrip() + """
select * from rv"""))
def q_pip_review(spark, sf):
    """OCR review: paths, cleaned text, folded decisions, stage export."""
    return _pip_reviewed(spark, sf).select("row_id", "path", "ocr_accepted", "scene_label", "cleaned_text")


@register("q_pip_tag", O.with_views(["v_mapped", "v_path_rows", "v_review_events"], _PIP_REVIEW_SQL.lstrip() + f"""
, t as (select *, {O.tokens('cleaned_text')} as ws from rv where cleaned_text <> '')
select row_id, case when ocr_accepted then 'ok' else 'rejected' end as tag_status,
  array_to_string(list_transform(ws, lambda w, i: w || (case when not ocr_accepted then '@O' else '@'
    || (case when i = 1 then 'B' else 'I' end) || (case scene_label when 'chyron' then 'F:1' else 'R:1' end) end)), ' ') as tagged
from t"""))
def q_pip_tag(spark, sf):
    """Reviewed rows through the tagger."""
    return flows.tag_batch(_pip_reviewed(spark, sf), _stub_tagger, 1, 0.0).select("row_id", "tag_status", "tagged")


@register("q_pip_adjudicate", O.with_views(["v_mapped", "v_tagged", "v_adjudication_events"], _ADJUDICATED_SQL.lstrip() + """
select guid, time_point, scene_label, cleaned_text, tagged as labels from t where accepted"""))
def q_pip_adjudicate(spark, sf):
    """Adjudication: decisions and edits applied, final export."""
    return flows.adjudicate_batch(_tagged_rows(spark, sf), V.v_adjudication_events(spark, sf))[1]


@register("q_pip_checks", O.with_views(["v_mapped", "v_tagged", "v_adjudication_events"], _ADJUDICATED_SQL.lstrip()
          + ", edited as (select row_id as doc_id, cleaned_text, tagged from t)" + _PARSE_SQL.replace("v_tagged", "edited") + f"""
select doc_id as row_id, parse_error,
       {O.tokens("regexp_replace(tagged, '@.*? |@.*$', ' ', 'g')")} = {O.tokens('cleaned_text')} as verbatim_ok
from errs join edited using (doc_id)"""))
def q_pip_checks(spark, sf):
    """Adjudication: the checks of each row's last text, tags that do not parse and words that were
    changed."""
    return flows.adjudicate_batch(_tagged_rows(spark, sf), V.v_adjudication_events(spark, sf))[0]


# annotations of the gold flow: every third frame goes on with the one before
_GOLD_FLOW_SQL = """
, a as (select *, annotated and frame_num % 3 = 0 as continuing, 'f ' || frame_num as filler from v_frames)
, bx as (select 'cpb-aacip-' || (l_suppkey % 100) as guid, (l_orderkey * 10) % 900 + 15 * l_linenumber as frame_num, l_partkey as box_idx from lineitem)
, pl as (select cast(guid as varchar) as guid, frame_num // 8 as frame, frame_num as seq,
                case when frame_num % 7 = 6 then 'delete' else 'add' end as action, role,
                case when frame_num % 5 = 4 then '' else filler end as fillers from v_credits)"""


@register("q_pip_gold", O.with_views(["v_timeframes", "v_frames", "v_credits"], _GOLD_FLOW_SQL.lstrip() + f"""
, s as (select distinct guid, frame_num from (select guid, unnest(range(start_frame, end_frame, 15)) as frame_num from v_timeframes))
, td as (select guid, frame_num from s where (guid, frame_num) not in (select (guid, frame_num) from v_frames))
, p as (select guid, frame_num, skip_reason, role, filler,
               max(case when annotated and skip_reason is null then frame_num end) over ({_PREV_W}) as source_frame,
               max(case when not continuing then frame_num end) over (
                 partition by guid order by frame_num rows between unbounded preceding and current row) as chain_start from a)
, ch as (select *, row_number() over (partition by guid, chain_start order by frame_num) - 1 as place from p where chain_start is not null)
, n as (select guid, count(*) as n_total from s group by guid)
, dn as (select guid, count(*) as n_done from v_frames group by guid)
, st as (select guid, frame, role, max(case when action = 'delete' or fillers = '' then seq end) as rs,
                max(case when action = 'delete' then seq end) as dl, max(case when action = 'add' then seq end) as ad
         from pl group by all)
, kept as (select pl.guid, pl.frame, pl.role, pl.seq, list_transform(string_split(pl.fillers, chr(10)), lambda x: {O.strip('x')}) as f
           from pl join st using (guid, frame, role)
           where action = 'add' and fillers <> '' and (dl is null or ad > dl) and (rs is null or seq > rs))
select 'todo' as part, guid, frame_num, null::bigint as other, null as text from td
union all select 'next', guid, coalesce((select min(frame_num) from td where td.guid = g.guid), max(frame_num)), count(*), null
  from s g group by guid
union all select 'duplicate', guid, frame_num, source_frame, null from p where skip_reason = 'DUPLICATE'
union all select 'progress', guid, coalesce(n_done, 0), coalesce(n_total, 0), coalesce(n_done, 0) || '/' || coalesce(n_total, 0)
  from n full join dn using (guid)
union all select 'chain', guid, frame_num, chain_start, place || ':' || role || '=' || filler from ch
union all select 'binding', guid, frame, seq, role || '=' || unnest(f) from kept
union all select 'binding', guid, frame, null, role from st where ad is not null and (dl is null or ad > dl)
  and not exists (select 1 from kept k where k.guid = st.guid and k.frame = st.frame and k.role = st.role)
union all select 'box', s.guid, s.frame_num, box_idx, null from s join bx using (guid, frame_num)""".lstrip()))
def q_pip_gold(spark, sf):
    """Gold annotation: sampled frames still to do, each guid's next frame and progress, sources of
    duplicates, continuation chains with their bindings, bindings folded from the pair log, boxes
    of the sampled frames."""
    c = F.col
    ann = V.v_frames(spark, sf).withColumns({
        "continuing": c("annotated") & (c("frame_num") % 3 == 0), "filler": F.concat(F.lit("f "), c("frame_num").cast("string"))})
    log = _pair_log(spark, sf).withColumnRenamed("frame", "frame_num").withColumn("guid", c("guid").cast("string"))
    bx = V.table(spark, sf, "lineitem").select(
        F.concat(F.lit("cpb-aacip-"), (c("l_suppkey") % 100).cast("string")).alias("guid"),
        ((c("l_orderkey") * 10) % 900 + 15 * c("l_linenumber")).cast("long").alias("frame_num"), c("l_partkey").alias("box_idx"))
    out = flows.gold_frames(V.v_timeframes(spark, sf), ann, log, bx)
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    part = lambda name, key, frame, other, t=text: out[key].select(
        F.lit(name).alias("part"), "guid", c(frame).alias("frame_num"), other.alias("other"), t.alias("text"))
    pair = F.concat_ws("=", "role", "filler")
    parts = [part("todo", "todo", "frame_num", none), part("next", "next", "next_frame", c("n_total")),
             part("duplicate", "duplicates", "frame_num", c("source_frame")), part("progress", "progress", "n_done", c("n_total"), c("progress")),
             part("chain", "chains", "frame_num", c("chain_start"), F.concat(c("place").cast("string"), F.lit(":"), pair)),
             part("binding", "bindings", "frame_num", c("seq"), pair), part("box", "boxes", "frame_num", c("box_idx"))]
    return functools.reduce(DataFrame.unionByName, parts)


@register("q_live_progress", O.with_views(["v_frames"], """
, t as (select guid, count(*) as n_total from v_frames group by guid)
, d as (select drop_no, guid, count(*) as n_done from v_frames, (values (1), (2)) v(drop_no)
        where annotated and (drop_no = 2 or frame_num % 2 = 0) group by drop_no, guid)
select drop_no, t.guid, coalesce(n_done, 0) as n_done, n_total, coalesce(n_done, 0) || '/' || n_total as progress
from t cross join (values (1), (2)) v(drop_no) left join d using (drop_no, guid)""".lstrip()))
def q_live_progress(spark, sf):
    """The progress table after each of two drops of saves, the second with saves of the first again:
    equal to the batch table each time."""
    f = V.v_frames(spark, sf)
    base, saved = scratch_path(spark, "live"), f.filter("annotated").select("guid", "frame_num")
    out = []
    for i, drop in enumerate((saved.filter("frame_num % 2 = 0"), saved.filter("frame_num % 2 <> 0 or frame_num % 10 = 0")), 1):
        drop.write.parquet(f"{base}/src/drop{i}")
        stream = spark.readStream.schema(drop.schema).option("recursiveFileLookup", "true").parquet(f"{base}/src")
        (progress_stream(stream, f).writeStream.outputMode("update").option("checkpointLocation", f"{base}/ckpt")
         .foreachBatch(lambda df, b: df.withColumn("batch_id", F.lit(b)).write.mode("append").parquet(f"{base}/sink"))
         .trigger(availableNow=True).start().awaitTermination())
        table = progress_table(spark.read.parquet(f"{base}/sink"), f).withColumn("drop_no", F.lit(i))
        out.append(materialize(table, "progress"))  # two reads of one folder are one to the planner
    return out[0].unionByName(out[1])


# A session log: ten conversations make up a video, two turns a frame, four actions a turn.
_SESSION_SQL = f"""
, turns as (select guid // 10 as video, (guid % 10) * 8 + frame_num as t, role, filler from v_credits)
, log as (select 'video' || cast(video as varchar) as guid, t * 4 + p as seq, t // 2 as frame_num,
       case p when 0 then 'fill' when 1 then 'fill' when 2 then case when t % 3 = 2 then 'copy' else 'add' end
              else case when t % 7 in (0, 1) then 'next' when t % 7 in (2, 6) then 'cont' when t % 7 = 3 then 'skip'
                        when t % 7 = 4 then 'delete' else 'copy' end end as action,
       case p when 0 then 'role' when 1 then 'fillers' when 3 then case when t % 7 = 4 then role else '' end else '' end as name,
       case p when 0 then role when 1 then filler
              when 3 then case when t % 7 = 3 and t % 2 = 1 then 'DUPLICATE' else '' end else '' end as value
  from turns, (select unnest([0, 1, 2, 3]) as p))
, ev as (select * replace (coalesce(name, '') as name, coalesce(value, '') as value), row_number() over (partition by guid order by seq) as n
  from (select * from log qualify row_number() over (partition by guid, seq order by name, value) = 1))
, steps as (
  select guid, cast(0 as bigint) as n, cast(map {{}} as map(varchar, varchar[])) as roles, '' as sr, '' as sf, cast(null as bigint) as chain,
         cast(map {{}} as map(bigint, map(varchar, varchar[]))) as saved, cast(null as bigint) as frame_num, cast(null as bigint) as seq,
         cast(null as bigint) as continued_from, cast(null as varchar) as skip_reason, false as wrote, cast(map {{}} as map(varchar, varchar[])) as rec
  from (select distinct guid from ev)
  union all
  select guid, n,
         case when save then map {{}}
              when action = 'delete' then map_from_entries(list_filter(map_entries(roles), lambda e: e.key <> name))
              when action = 'copy' and near is not null then map_concat(roles, saved[near]) else roles end,
         sr, sf, case when save and action = 'next' then frame_num else chain end,
         case when save then map_concat(saved, map {{frame_num: roles}})
              when skip then map_from_entries(list_filter(map_entries(saved), lambda e: e.key <> frame_num)) else saved end,
         frame_num, seq, case when save and action = 'cont' then chain end, case when skip then value end, save or skip,
         case when save then roles else map {{}} end
  from (select *, action in ('next', 'cont') and cardinality(roles) > 0 and (action = 'next' or chain is not null) as save,
               action = 'skip' and value <> '' as skip, list_max(list_filter(map_keys(saved), lambda f: f < frame_num)) as near
    from (select r.guid, e.n, e.seq, e.frame_num, e.action, e.name, e.value, r.chain, r.saved,
                 case when not adds or (r.sr = '' and r.sf = '') then r.roles
                      when r.sf = '' then map_concat(r.roles, map {{r.sr: cast([] as varchar[])}})
                      else map_concat(r.roles, map {{r.sr: list_concat(coalesce(r.roles[r.sr], []),
                           list_transform(string_split(r.sf, chr(10)), lambda x: {O.strip('x')}))}}) end as roles,
                 case when adds then '' when e.action = 'fill' and e.name = 'role' then concat_ws(' ', nullif(r.sr, ''), e.value) else r.sr end as sr,
                 case when adds then '' when e.action = 'fill' and e.name = 'fillers' then concat_ws(' ', nullif(r.sf, ''), e.value) else r.sf end as sf
          from steps r join (select *, action in ('add', 'next', 'cont') as adds from ev) e on e.guid = r.guid and e.n = r.n + 1)))
, last as (select * from steps where wrote qualify row_number() over (partition by guid, frame_num order by seq desc) = 1)"""


def _session_log(spark, sf) -> DataFrame:
    c = V.v_credits(spark, sf)
    t = (F.col("guid") % 10) * 8 + F.col("frame_num")
    pick = F.col("t") % 7
    move = (F.when(pick.isin(0, 1), "next").when(pick.isin(2, 6), "cont").when(pick == 3, "skip").when(pick == 4, "delete").otherwise("copy"))
    does = lambda p, action, name, value: F.struct(F.lit(p).alias("p"), action.alias("action"), name.alias("name"), value.alias("value"))
    none = F.lit("")
    acts = F.array(does(0, F.lit("fill"), F.lit("role"), F.col("role")), does(1, F.lit("fill"), F.lit("fillers"), F.col("filler")),
                   does(2, F.when(F.col("t") % 3 == 2, "copy").otherwise("add"), none, none),
                   does(3, move, F.when(pick == 4, F.col("role")).otherwise(none),
                        F.when((pick == 3) & (F.col("t") % 2 == 1), "DUPLICATE").otherwise(none)))
    rows = c.select(F.floor(F.col("guid") / 10).alias("video"), t.alias("t"), "role", "filler").select("video", "t", F.explode(acts).alias("a"))
    return rows.select(F.concat(F.lit("video"), F.col("video").cast("string")).alias("guid"), (F.col("t") * 4 + F.col("a.p")).cast("long").alias("seq"),
                       F.floor(F.col("t") / 2).alias("frame_num"), "a.action", "a.name", "a.value")


def _session_records(spark, sf) -> DataFrame:
    """The log in two drops, one ``availableNow`` pass each; the second brings every seventh
    event of the first again."""
    base = scratch_path(spark, "sessions")
    log = materialize(_session_log(spark, sf), "session-log")
    h = log.agg(F.floor((F.coalesce(F.max("seq"), F.lit(0)) + 1) / 2)).first()[0]
    first = F.col("seq") < h
    for i, drop in enumerate((first, ~first | (F.col("seq") % 7 == 0))):
        log.filter(drop).write.parquet(f"{base}/src/drop{i}")
        stream = (spark.readStream.schema(LOG).option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", "*.parquet").parquet(f"{base}/src"))
        q = (replay_sessions(stream).writeStream.outputMode("update").option("checkpointLocation", f"{base}/ckpt")
             .foreachBatch(lambda df, b: df.write.mode("append").parquet(f"{base}/sink")).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(f"{base}/sink")


def _with_recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@register("q_session_replay", _with_recursive(O.with_views(["v_credits"], _SESSION_SQL.lstrip() + """
, own as (select guid, frame_num, seq, continued_from, skip_reason, unnest(case when cardinality(rec) = 0 then [null] else map_entries(rec) end) as b
          from last)
, long as (select *, unnest(case when b is null or len(b.value) = 0 then [0] else generate_series(0, len(b.value) - 1) end) as place from own)
select guid, frame_num, seq, continued_from, skip_reason, b.key as role,
       case when b is not null and len(b.value) > 0 then cast(place as bigint) end as place, b.value[place + 1] as filler from long""")))
def q_session_replay(spark, sf):
    """Annotation sessions replayed in order (slots, pairs, resets, deletes, copies, skips, saves,
    continuations), each frame's last record in long form."""
    last = last_records(_session_records(spark, sf))
    roles = last.select("guid", "frame_num", "seq", "continued_from", "skip_reason", F.explode_outer("bindings").alias("b"))
    return roles.select("guid", "frame_num", "seq", "continued_from", "skip_reason", F.col("b.role").alias("role"),
                        F.posexplode_outer("b.fillers").alias("place", "filler")).withColumn("place", F.col("place").cast("long"))


@register("q_session_ignored", _with_recursive(O.with_views(["v_credits"], _SESSION_SQL[:_SESSION_SQL.index(", steps as")].lstrip() + """
, half as (select (max(seq) + 1) // 2 as h from ev)
select guid, count(*) filter (where seq < h and seq % 7 = 0) as n_ignored from ev, half group by guid""")))
def q_session_ignored(spark, sf):
    """Events of each session that came again and were not applied a second time."""
    return ignored_events(_session_records(spark, sf)).select("guid", "n_ignored")
