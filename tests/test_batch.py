"""Batch building: dedupe order, class arg-max, guid extraction, annotation JSON."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from credline.operators import batch
from credline.schemas import GOLD_ROW
from credline.sources import annotation_json as AJ


def test_two_stage_dedupe_order(spark):
    rows = [(1, "g1", "chyron", "Foo!"), (2, "g1", "chyron", "foo"), (3, "g2", "chyron", "foo")]
    df = spark.createDataFrame(rows, "row_id long, guid string, scene_label string, textdocument string")
    norm_then_exact = batch.dedupe_exact(
        batch.dedupe_normalized(df, ["guid", "scene_label"], "textdocument", "row_id"), "textdocument", "row_id")
    assert sorted(r.row_id for r in norm_then_exact.collect()) == [1, 3]
    exact_only = batch.dedupe_exact(df, "textdocument", "row_id")
    assert sorted(r.row_id for r in exact_only.collect()) == [1, 2]


def test_dedupe_idempotent(spark):
    df = spark.createDataFrame([(i, "g", "chyron", t) for i, t in enumerate(["a", "A", "a", "b!", "b"])],
                               "row_id long, guid string, scene_label string, textdocument string")
    once = batch.dedupe_normalized(df, ["guid", "scene_label"], "textdocument", "row_id")
    twice = batch.dedupe_normalized(once, ["guid", "scene_label"], "textdocument", "row_id")
    assert sorted(once.collect()) == sorted(twice.collect())


def test_argmax_first_max_wins(spark):
    df = spark.sql("select map('S', 0.5D, 'C', 0.9D, 'I', 0.9D) as m union all "
                   "select map('N', 0.1D) union all select map('Y', 0.3D, 'B', 0.2D)")
    got = [(r.k, r.v) for r in df.select(batch.argmax_class("m").alias("b")).select(
        F.col("b.key").alias("k"), F.col("b.value").alias("v")).collect()]
    assert got == [("C", 0.9), ("N", 0.1), ("Y", 0.3)]


def test_scene_map(spark):
    df = spark.createDataFrame([(c,) for c in "INYCSB"], "scene_code string")
    got = [r.scene_label for r in batch.map_scene(df).collect()]
    assert got == ["chyron", "chyron", "chyron", "credits"]


def test_guid_from_location(spark):
    df = spark.createDataFrame([("/d/cpb-aacip-12-abc3x.mp4",), ("cpb-aacip_77-q0w9",),
                                ("nothing.mp4",)], "loc string")
    got = [r[0] for r in df.select(batch.guid_from_location("loc")).collect()]
    assert got == ["cpb-aacip-12-abc3x", "cpb-aacip_77-q0w", None]


def _doc(loc, views, mime="video"):
    return {"documents": [{"@type": "VideoDocument", "properties": {"id": "d1", "mime": mime, "location": loc}}],
            "views": views}


def _tp(i, t, cls):
    return {"@type": "TimePoint", "properties": {"id": i, "timePoint": t, "classification": cls}}


def _td(i, text):
    return {"@type": "TextDocument", "properties": {"id": i, "text": {"@value": text}}}


def _al(s, t):
    return {"@type": "Alignment", "properties": {"id": "a", "source": s, "target": t}}


def test_annotation_json_one_file_per_document(spark):
    d = tempfile.mkdtemp(prefix="credline-json-")
    docs = {
        "a.json": _doc("/m/cpb-aacip-1-aa.mp4", [
            {"id": "v1", "annotations": [_tp("tp_1", 100, {"S": 0.2, "I": 0.7}), _td("td_1", "  hello \n"),
                                         _tp("tp_2", 200, {"C": 0.6, "I": 0.6}), _td("td_2", "two")]},
            {"id": "v2", "annotations": [_al("v1:tp_1", "td_1"), _al("tp_2", "v1:td_2"),
                                         _al("bb_1", "td_1"), _al("tp_9", "td_1"), _td("td_1", "later view")]}]),
        "b.json": _doc("/m/cpb-aacip-2-bb.mp4", [
            {"id": "v1", "annotations": [_tp("tp_1", 5, {"S": 0.9}), _td("td_1", "skip me"),
                                         _al("tp_1", "td_1")]}]),
        "c.json": "{not json",
    }
    for name, doc in docs.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(doc if isinstance(doc, str) else json.dumps(doc, indent=2))
    parsed = AJ.read_annotation_docs(spark, d, one_per_file=True)
    assert [os.path.basename(r.file) for r in AJ.quarantined(parsed).collect()] == ["c.json"]
    anns = AJ.materialize_annotations(spark, parsed)
    rows = AJ.ocr_rows(anns).orderBy("time_point").collect()
    got = [(r.guid, r.time_point, r.scene_code, r.scene_label, r.textdocument) for r in rows]
    # tp_1 -> short target td_1: the last view holding it wins; tp_2: tie goes to C (first);
    # bb_1 fails the alignment filter; tp_9 does not resolve; b.json is label S (dropped)
    assert got == [("cpb-aacip-1-aa", 100, "I", "chyron", "later view"),
                   ("cpb-aacip-1-aa", 200, "C", "credits", "two")]


def test_annotation_json_lines(spark):
    d = tempfile.mkdtemp(prefix="credline-jsonl-")
    doc = _doc("/m/cpb-aacip-3-cc.mp4", [{"id": "v1", "annotations": [
        _tp("tp_1", 7, {"N": 1.0}), _td("td_1", "x y"), _al("tp_1", "td_1")]}])
    with open(os.path.join(d, "part.json"), "w") as f:
        f.write(json.dumps(doc) + "\n" + json.dumps(doc) + "\n")
    anns = AJ.materialize_annotations(spark, AJ.read_annotation_docs(spark, d, one_per_file=False))
    rows = AJ.ocr_rows(anns).collect()
    assert [(r.guid, r.time_point, r.textdocument) for r in rows] == [("cpb-aacip-3-cc", 7, "x y")] * 2


def test_gold_records_latest_save_wins(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="credline-gold-"), "g")
    rows = [("cpb-aacip-1", 15, 1, {"Director": ["A"]}, {"_image_id": "cpb-aacip-1.15"}),
            ("cpb-aacip-1", 15, 2, {"Director": ["B", "C"], "": ["x"]}, {"_image_id": "cpb-aacip-1.15"}),
            ("cpb-aacip-1", 30, 1, {}, {"_image_id": "cpb-aacip-1.30", "_skip_reason": "DUPLICATE"}),
            ("cpb-aacip-2", 7, 1, {"Cast": []}, {"_image_id": "cpb-aacip-2.7", "_continued_from": "cpb-aacip-2.1"})]
    df = spark.createDataFrame(rows, "guid string, frame_num long, seq long, bindings map<string,array<string>>, "
                                     "meta map<string,string>")
    AJ.write_gold(df, d)
    want = {
        "cpb-aacip-1.15": ("cpb-aacip-1", 15, {"Director": ["B", "C"], "": ["x"]}, None, None),
        "cpb-aacip-1.30": ("cpb-aacip-1", 30, {}, None, "DUPLICATE"),
        "cpb-aacip-2.7": ("cpb-aacip-2", 7, {"Cast": []}, "cpb-aacip-2.1", None),
    }

    def rows_of(gold):
        assert gold.schema.fieldNames() == GOLD_ROW.fieldNames()
        return {r.image_id: (r.guid, r.frame_num, dict(r.bindings), r.continued_from, r.skip_reason) for r in gold.collect()}
    assert rows_of(AJ.read_gold(spark, d)) == want
    # one indented file per frame in a flat folder, as other tools write them
    flat = os.path.join(d, "flat")
    assert AJ.write_gold_files(df, flat) == 3
    assert sorted(os.listdir(flat)) == ["cpb-aacip-1.15.json", "cpb-aacip-1.30.json", "cpb-aacip-2.7.json"]
    with open(os.path.join(flat, "cpb-aacip-1.15.json")) as f:
        assert f.read().count("\n") > 3
    assert rows_of(AJ.read_gold_files(spark, flat)) == want


def test_only_the_type_video_names_the_guid(spark):
    d = tempfile.mkdtemp(prefix="credline-mime-")
    doc = _doc("/m/cpb-aacip-3-cc.mp4", [{"id": "v1", "annotations": [_tp("tp_1", 7, {"N": 1.0}), _td("td_1", "x y"), _al("tp_1", "td_1")]}])
    doc["documents"] += [{"properties": {"mime": "video", "location": "/m/cpb-aacip-4-dd.mp4"}},
                         {"properties": {"mime": "video/mp4", "location": "/m/cpb-aacip-5-ee.mp4"}}]
    with open(os.path.join(d, "x.json"), "w") as f:
        json.dump(doc, f)
    anns = AJ.materialize_annotations(spark, AJ.read_annotation_docs(spark, d))
    assert {r.guid for r in AJ.ocr_rows(anns).collect()} == {"cpb-aacip-4-dd"}
