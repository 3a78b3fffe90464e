"""End-to-end runs of the composite flows on small inputs."""

import json
import os
import tempfile

from credline.plans import flows
from tests.test_batch import _al, _doc, _td, _tp


def _json_dir():
    d = tempfile.mkdtemp(prefix="credline-flow-")
    views = [{"id": "v1", "annotations": [
        _tp("tp_1", 10, {"I": 0.9}), _td("td_1", "Jane DOE\nAnchor 2"),
        _tp("tp_2", 20, {"I": 0.8}), _td("td_2", "jane doe! anchor 2"),
        _tp("tp_3", 30, {"C": 0.7}), _td("td_3", "Producer\nOlga Winter"),
        _tp("tp_4", 40, {"C": 0.7}), _td("td_4", "Producer\nOlga Winter"),
        _al("tp_1", "td_1"), _al("tp_2", "td_2"), _al("tp_3", "td_3"), _al("tp_4", "td_4")]}]
    with open(os.path.join(d, "x.json"), "w") as f:
        json.dump(_doc("/m/cpb-aacip-9-zz.mp4", views), f)
    return d


def test_build_review_tag_adjudicate(spark):
    d = _json_dir()
    plain = flows.build_batch(spark, d)
    assert sorted(r.time_point for r in plain.collect()) == [10, 20, 30]
    rows = flows.build_batch(spark, d, dedupe=True)
    got = sorted((r.row_id, r.time_point, r.scene_label) for r in rows.collect())
    assert got == [(0, 10, "chyron"), (2, 30, "credits")]

    paths = spark.createDataFrame([("cpb-aacip-9-zz", 1, "/v/zz.mp4")], "guid string, file_ord long, path string")
    events = spark.createDataFrame([(0, 1, "submit"), (2, 2, "reject"), (2, 3, "submit")],
                                   "row_id long, seq long, action string")
    reviewed = flows.review_batch(rows, paths, events)
    rv = {r.row_id: (r.path, r.ocr_accepted, r.cleaned_text) for r in reviewed.collect()}
    assert rv == {0: ("/v/zz.mp4", True, "Jane DOE Anchor"), 2: ("/v/zz.mp4", False, "Producer Olga Winter")}

    def factory():
        return lambda text, label: " ".join(
            f"{w}@{'BF:1' if i == 0 else 'IF:1' if i == 1 else 'BR:1'}" for i, w in enumerate(text.split()))

    tagged = flows.tag_batch(reviewed, factory, max_retries=0)
    tg = {r.row_id: r.tagged for r in tagged.collect()}
    assert tg == {0: "Jane@BF:1 DOE@IF:1 Anchor@BR:1", 2: "Producer@O Olga@O Winter@O"}

    # the text of the last edit is exported, an undo does not take it back; row 2 has rejected
    # OCR, so its accept does not count
    log = [(0, 1, "edit", "Jane@O"), (0, 2, "edit", "Jane@BF:2 DOE@IF:2 Anchor@BR:2"), (0, 3, "undo", None), (0, 4, "accept", None),
           (2, 5, "accept", None)]
    adj_events = spark.createDataFrame(log, "row_id long, seq long, action string, payload string")
    checks, final = flows.adjudicate_batch(tagged.drop("tag_error"), adj_events)
    assert {(r.row_id, r.parse_error, r.verbatim_ok) for r in checks.collect()} == {(0, False, True), (2, False, True)}
    out = final.collect()
    assert [(r.guid, r.time_point, r.labels) for r in out] == [
        ("cpb-aacip-9-zz", 10, "Jane@BF:2 DOE@IF:2 Anchor@BR:2")]
    _, everything = flows.adjudicate_batch(tagged.drop("tag_error"), adj_events, include_rejected=True)
    assert sorted(r.labels for r in everything.collect()) == ["Jane@BF:2 DOE@IF:2 Anchor@BR:2", "Producer@O Olga@O Winter@O"]
    assert final.columns == ["guid", "time_point", "scene_label", "cleaned_text", "labels"]


def test_gold_frames(spark):
    tf = spark.createDataFrame([("g", 0, 31), ("h", 15, 16)], "guid string, start_frame long, end_frame long")
    ann = spark.createDataFrame([("g", 0), ("g", 15)], "guid string, frame_num long")
    out = flows.gold_frames(tf, ann)
    assert sorted((r.frame_idx, r.guid, r.frame_num) for r in out["frames"].collect()) == [
        (0, "g", 0), (1, "g", 15), (2, "g", 30), (3, "h", 15)]
    assert {r.guid: r.progress for r in out["progress"].collect()} == {"g": "2/3", "h": "0/1"}
    assert sorted((r.guid, r.frame_num) for r in out["todo"].collect()) == [("g", 30), ("h", 15)]
    assert {r.guid: (r.next_frame, r.all_done) for r in out["next"].collect()} == {"g": (30, False), "h": (15, False)}


def test_gold_frames_with_saves_log_and_boxes(spark):
    tf = spark.createDataFrame([("g", 0, 46)], "guid string, start_frame long, end_frame long")
    ann = spark.createDataFrame(
        [("g", 0, True, None, False, "Host", "a"), ("g", 15, True, "DUPLICATE", False, "Host", "x"), ("g", 30, True, None, True, "Cast", "b")],
        "guid string, frame_num long, annotated boolean, skip_reason string, continuing boolean, role string, filler string")
    log = spark.createDataFrame([("g", 30, 1, "add", "Cast", "b\nc")], "guid string, frame_num long, seq long, action string, role string, fillers string")
    box = spark.createDataFrame([("g", 30, "t"), ("g", 31, "u")], "guid string, frame_num long, text string")
    out = flows.gold_frames(tf, ann, log, box)
    assert [(r.frame_num, r.source_frame) for r in out["duplicates"].collect()] == [(15, 0)]
    assert sorted((r.chain_start, r.place, r.filler) for r in out["chains"].collect()) == [(0, 0, "a"), (15, 0, "x"), (15, 1, "b")]
    assert sorted((r.frame_num, r.role, r.filler) for r in out["bindings"].collect()) == [(30, "Cast", "b"), (30, "Cast", "c")]
    assert [(r.frame_num, r.text) for r in out["boxes"].collect()] == [(30, "t")]


def test_a_batch_writes_its_rows_once(spark, monkeypatch):
    """The rows that the index has written are not written again."""
    from credline.operators import common
    names, write = [], common.materialize
    for module in (common, flows, flows.batch):
        if hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", lambda df, name: names.append(name) or write(df, name))
    flows.build_batch(spark, _json_dir())
    assert sorted(names) == ["dedupe-keys", "index"]


def test_checks_come_from_one_pass(spark):
    """The checks of a row's last text are read off one parse; the texts are not joined to themselves."""
    tagged = spark.createDataFrame([(1, "g", 1, "chyron", "a b", "a@BF:1 b@IF:1", True), (2, "g", 2, "chyron", "a b", "a@BF", True)],
                                   "row_id long, guid string, time_point long, scene_label string, cleaned_text string, tagged string, ocr_accepted boolean")
    events = spark.createDataFrame([(1, 1, "accept", None)], "row_id long, seq long, action string, payload string")
    checks, _ = flows.adjudicate_batch(tagged, events)
    assert {(r.row_id, r.parse_error, r.verbatim_ok) for r in checks.collect()} == {(1, False, True), (2, True, False)}
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # the log's last edit, and the log's state
