"""Annotation JSON: the nested multimedia-annotation documents and the per-frame gold
annotation records.

A folder holds one annotation document per file (files are read whole), or one document
per line (JSON Lines). Documents are parsed with an explicit schema; one that does not
parse lands in ``_corrupt`` and yields no rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credline.functions.text import strip_ws
from credline.operators.batch import (alignment_filter, argmax_class, guid_from_location,
                                      resolve_refs, scene_label)
from credline.operators.frames import last_write, parse_frame_name
from credline.schemas import ANNOTATION_DOC
from credline.session import scratch_path, ship_package

CORRUPT = "_corrupt"


def read_annotation_docs(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """file, documents, views, _corrupt — one row per annotation document, parsed once by
    the JSON source with an explicit schema (PERMISSIVE: a malformed document keeps only
    ``_corrupt``).

    ``file`` is the key that scopes annotation ids: the file path when every file holds
    one document, else the path plus the place of the line, padded so that keys sort in the
    order of the lines (stable once the flattened table is written by
    ``materialize_annotations``).
    """
    df = (spark.read.schema(ANNOTATION_DOC).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", one_per_file)
          .json(path))
    key = (F.col("_metadata.file_path") if one_per_file else
           F.concat_ws("#", F.col("_metadata.file_path"), *[F.lpad(c.cast("string"), 20, "0") for c in (
               F.col("_metadata.file_block_start"), F.monotonically_increasing_id())]))
    return df.select(key.alias("file"), "documents", "views", CORRUPT)


def quarantined(docs: DataFrame) -> DataFrame:
    """Documents that did not parse: file, _corrupt (raw text). A parsed field is read
    along, as the JSON source refuses queries that read only the corrupt-record column."""
    return docs.filter(F.col(CORRUPT).isNotNull()).select(
        "file", CORRUPT, F.col("views").isNull().alias("unparsed"))


def flatten_annotations(docs: DataFrame) -> DataFrame:
    """file, guid, view_ord, view_id, ann_ord, type, ann_id, source, target, time_point,
    classification, text — one row per annotation of every parsable document. ``guid``
    comes from the location of the document's last video document (NULL when none)."""
    ok = docs.filter(F.col(CORRUPT).isNull())
    videos = F.filter("documents", lambda d: d["properties"]["mime"] == "video")
    last_video = F.when(F.size(videos) > 0, F.element_at(videos, -1))
    views = ok.select("file", guid_from_location(last_video["properties"]["location"]).alias("guid"),
                      F.posexplode("views").alias("view_ord", "view"))
    anns = views.select("file", "guid", "view_ord", F.col("view.id").alias("view_id"),
                        F.posexplode("view.annotations").alias("ann_ord", "ann"))
    p = F.col("ann.properties")
    return anns.select(
        "file", "guid", F.col("view_ord").cast("long"), "view_id", F.col("ann_ord").cast("long"),
        F.col("ann.@type").alias("type"), p["id"].alias("ann_id"), p["source"].alias("source"),
        p["target"].alias("target"), p["timePoint"].alias("time_point"),
        p["classification"].alias("classification"), p["text"]["@value"].alias("text"))


def materialize_annotations(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Flatten once and write the result as Parquet below the checkpoint folder: the JSON
    is parsed a single time and every later join reads only the columns it needs."""
    path = scratch_path(spark, "annotations")
    flatten_annotations(docs).write.parquet(path)
    return spark.read.parquet(path)


def ocr_rows(anns: DataFrame, keep_unresolved: bool = False) -> DataFrame:
    """Flat OCR rows from flattened annotations (``materialize_annotations``): for each
    alignment from a time point to a text document, the text, the time point and its best
    scene class.

    Output: file, view_ord, ann_ord, guid, time_point, scene_code, confidence,
    scene_label, textdocument. Rows whose scene maps to no label are dropped; rows whose
    references do not resolve (or whose document names no video) are dropped unless
    ``keep_unresolved``.
    """
    is_type = lambda t: F.col("type").contains(t)
    al = alignment_filter(
        anns.filter(is_type("Alignment")).select(
            "file", "guid", "view_ord", "ann_ord", F.col("source").alias("source_id"),
            F.col("target").alias("target_id")))
    td = anns.filter(is_type("TextDocument")).select("file", "view_id", "view_ord", "ann_ord", "ann_id", "text")
    tp = anns.filter(is_type("TimePoint")).select("file", "view_id", "view_ord", "ann_ord", "ann_id",
                                                   "time_point", "classification")
    r = resolve_refs(al, td, ["file"], "target_id", ["text"], "td_")
    r = resolve_refs(r, tp, ["file"], "source_id", ["time_point", "classification"], "tp_")
    best = argmax_class(F.col("tp_classification"))
    out = r.select(
        "file", "view_ord", "ann_ord", "guid", F.col("tp_time_point").alias("time_point"),
        best["key"].alias("scene_code"), best["value"].alias("confidence"),
        scene_label(best["key"]).alias("scene_label"),
        strip_ws(F.col("td_text")).alias("textdocument"))
    if not keep_unresolved:
        out = out.filter(F.col("textdocument").isNotNull() & F.col("time_point").isNotNull()
                         & F.col("guid").isNotNull())
    return out.filter(F.col("scene_label").isNotNull())


# --------------------------------------------------------------------------- gold records
def encode_gold(bindings: Column, meta: Column) -> Column:
    """One flat JSON object holding role keys (lists of fillers) and ``_`` meta keys
    (strings)."""
    both = F.map_concat(*[F.transform_values(m, lambda k, v: v.cast("variant")) for m in (bindings, meta)])
    return F.to_json(both)


def _gold_entries(value: Column) -> Column:
    """The record as map<string,variant>: parsed once, values of either kind keep theirs."""
    return F.from_json(value, "map<string,variant>")


def parse_gold(value: Column) -> tuple[Column, Column]:
    """(bindings map<string,array<string>>, meta map<string,string>) of a gold record;
    keys starting with ``_`` are meta keys. A value of another kind is NULL (see
    ``gold_faults``)."""
    m = _gold_entries(value)
    roles = F.map_filter(m, lambda k, v: ~k.startswith("_"))
    meta = F.map_filter(m, lambda k, v: k.startswith("_"))
    return (F.transform_values(roles, lambda k, v: F.try_variant_get(v, "$", "array<string>")),
            F.transform_values(meta, lambda k, v: F.try_variant_get(v, "$", "string")))


def gold_faults(value: Column) -> Column:
    """Why a text is no gold record: ``no JSON object``, or the keys whose values are of the wrong
    kind (a role needs a list of strings, a meta key a string); NULL for a good one."""
    m = _gold_entries(value)
    kind = lambda v: F.schema_of_variant(v)
    wrong = F.map_filter(m, lambda k, v: F.when(k.startswith("_"), kind(v) != "STRING").otherwise(
        ~kind(v).isin("ARRAY<STRING>", "ARRAY<VOID>")))
    keys = F.array_join(F.array_sort(F.map_keys(wrong)), ",")
    return F.when(m.isNull(), F.lit("no JSON object")).when(keys != "", F.concat(F.lit("wrong kind: "), keys))


def _latest_gold(records: DataFrame, seq: str) -> DataFrame:
    latest = last_write(records, ["guid", "frame_num"], seq, ["bindings", "meta"])
    return latest.select("guid", "frame_num", encode_gold(F.col("bindings"), F.col("meta")).alias("value"))


def write_gold(records: DataFrame, path: str, seq: str = "seq") -> None:
    """Gold records (guid, frame_num, seq, bindings map<string,array<string>>, meta
    map<string,string>) as JSON Lines, clustered by (guid, frame). Saves are an append-only
    log: the latest save of a frame wins, as a re-save overwrites the frame's record."""
    (_latest_gold(records, seq).repartitionByRange("guid", "frame_num").sortWithinPartitions("guid", "frame_num")
     .select("value").write.text(path))


def write_gold_files(records: DataFrame, folder: str, seq: str = "seq") -> int:
    """The latest gold records as one indented ``<guid>.<frame>.json`` each in one flat
    folder (of any file system Arrow knows), for tools that expect that form. A repeated
    task writes the same files again. Returns the number of files."""
    uri = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder

    def run(batches):
        from pyarrow import fs
        files, base = fs.FileSystem.from_uri(uri)
        files.create_dir(base, recursive=True)
        for batch in batches:
            for guid, frame, value in zip(batch["guid"], batch["frame_num"], batch["value"]):
                with files.open_output_stream(f"{base}/{guid}.{frame}.json") as out:
                    out.write(json.dumps(json.loads(value), indent=2).encode())
            yield pd.DataFrame({"n": [len(batch)]})

    ship_package(records.sparkSession)
    return _latest_gold(records, seq).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _gold_rows(raw: DataFrame, guid: Column, frame: Column) -> DataFrame:
    b, m = parse_gold(F.col("value"))
    return raw.select(guid.alias("guid"), frame.alias("frame_num"), b.alias("bindings"), m["_image_id"].alias("image_id"),
                      m["_continued_from"].alias("continued_from"), m["_skip_reason"].alias("skip_reason"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold records (``schemas.GOLD_ROW``) of JSON Lines; guid and frame come from the
    record's image id."""
    raw = spark.read.text(path)
    guid, frame = parse_frame_name(parse_gold(F.col("value"))[1]["_image_id"])
    return _gold_rows(raw, guid, frame)


def read_gold_files(spark: SparkSession, folder: str) -> DataFrame:
    """Gold records of a flat folder of ``<guid>.<frame>.json`` files, indented or not; guid
    and frame come from the file name."""
    raw = (spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
           .select("value", F.col("_metadata.file_name").alias("_f")))
    guid, frame = parse_frame_name("_f")
    return _gold_rows(raw, guid, frame)
