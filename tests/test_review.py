"""Review and adjudication folds: batch closed form vs sequential replay vs stream."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from credline.operators import review
from credline.streaming import state as ST

ACTIONS = ["reject", "swap", "delete", "submit", "undo"]


def _replay(events):
    out = {}
    for row in sorted({r for r, _, _ in events}):
        rej = acc = ann = False
        swaps = dels = 0
        for _, _, a in sorted((e for e in events if e[0] == row), key=lambda e: e[1]):
            if a == "reject":
                rej = not rej
            elif a == "swap":
                swaps += 1
            elif a in ("submit", "delete"):
                dels += a == "delete"
                ann, acc = True, not rej
            elif a == "undo":
                ann, rej = False, False
        out[row] = (swaps % 2 == 1, dels % 2 == 1, ann, acc)
    return out


def _log(n=600, rows=25, seed=3):
    rnd = random.Random(seed)
    return [(rnd.randrange(rows), seq, rnd.choice(ACTIONS)) for seq in range(n)]


def test_review_fold_equals_replay(spark):
    ev = _log()
    df = spark.createDataFrame(ev, "row_id long, seq long, action string")
    got = {r.row_id: (r.label_adjusted, r.deleted, r.annotated, r.ocr_accepted)
           for r in review.fold_review(df).collect()}
    assert got == _replay(ev)


def test_review_stream_equals_batch(spark):
    ev = _log(seed=11)
    schema = "row_id long, seq long, action string"
    src = tempfile.mkdtemp(prefix="credline-ev-")
    random.Random(1).shuffle(ev)  # a distributed log does not arrive in order of seq
    half = len(ev) // 2
    spark.createDataFrame(ev[:half], schema).write.parquet(os.path.join(src, "drop1"))
    stream = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
    out = ST.review_state_stream(stream)
    sink = tempfile.mkdtemp(prefix="credline-sink-")
    ckpt = tempfile.mkdtemp(prefix="credline-ckpt-")

    def write(batch_df, batch_id):
        batch_df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink)

    q = (out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    # the rest, and a part of the first drop once more
    spark.createDataFrame(ev[half:] + ev[:40], schema).write.parquet(os.path.join(src, "drop2"))
    q = (out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(sink)
    last = res.groupBy("row_id").agg(F.max_by(F.struct("label_adjusted", "deleted", "annotated", "ocr_accepted"),
                                              "batch_id").alias("s")).collect()
    got = {r.row_id: tuple(r.s) for r in last}
    assert got == _replay(ev)


def test_adjudication_fold_and_stream(spark):
    rnd = random.Random(5)
    ev = [(rnd.randrange(10), seq, rnd.choice(["accept", "reject", "edit", "undo", "other"])) for seq in range(200)]
    df = spark.createDataFrame(ev, "row_id long, seq long, action string")
    batch = {r.row_id: (r.adjudicated, r.accepted, r.n_edits) for r in review.fold_adjudication(df).collect()}
    exp = {}
    for row in {e[0] for e in ev}:
        adj = acc = False
        edits = 0
        for _, _, a in sorted((e for e in ev if e[0] == row), key=lambda e: e[1]):
            if a in ("accept", "reject"):
                adj, acc = True, a == "accept"
            elif a in ("edit", "undo"):
                adj = acc = False
                edits += a == "edit"
        exp[row] = (adj, acc, edits)
    assert batch == exp


def test_export_reviewed_rules(spark):
    df = spark.createDataFrame(
        [(1, "g", "chyron", 0.9, "Hello World", False, True), (2, "g", "chyron", 0.9, "x", True, True),
         (3, "g", "credits", None, "Bye now", False, False), (4, "g", "credits", 0.1, "Ok ok", None, True)],
        "row_id long, guid string, scene_label string, confidence double, textdocument string, "
        "deleted boolean, annotated boolean")
    out = review.export_reviewed(df)
    assert sorted(out.columns) == sorted(["row_id", "guid", "scene_label", "textdocument",
                                          "ocr_accepted", "cleaned_text"])
    # row 2 deleted, row 4 has NULL deleted (not == False); confidence is dropped before
    # the missing-value rule, so row 3 stays
    assert sorted(r.row_id for r in out.collect()) == [1, 3]


def test_apply_review_swaps_label(spark):
    rows = spark.createDataFrame([(1, "chyron"), (2, "credits"), (3, "chyron")], "row_id long, scene_label string")
    st = spark.createDataFrame([(1, True, False, True, True), (2, False, True, True, False)],
                               "row_id long, label_adjusted boolean, deleted boolean, annotated boolean, "
                               "ocr_accepted boolean")
    got = {r.row_id: (r.scene_label, r.deleted, r.label_adjusted) for r in review.apply_review(rows, st).collect()}
    assert got == {1: ("credits", False, True), 2: ("credits", True, False), 3: ("chyron", False, False)}


def test_paths_later_file_wins_and_missing(spark):
    p = spark.createDataFrame([("g1", 1, "/a"), ("g1", 2, "/b"), ("g2", 1, "/c")], "guid string, file_ord long, path string")
    rows = spark.createDataFrame([(1, "g1"), (2, "g3")], "row_id long, guid string")
    paths = review.latest_paths(p)
    got = {r.row_id: r.path for r in review.with_paths(rows, paths).collect()}
    assert got == {1: "/b", 2: None}
    assert [r.guid for r in review.missing_paths(rows, paths).collect()] == ["g3"]


def test_last_edit_and_rejected_rows(spark):
    log = [(1, 1, "edit", "e1"), (1, 2, "edit", None), (1, 3, "accept", None), (2, 4, "accept", None), (3, 9, "edit", "late"),
           (3, 5, "edit", "early"), (3, 10, "accept", None), (4, 11, "accept", None), (4, 12, "undo", None)]
    state = review.fold_adjudication(spark.createDataFrame(log, "row_id long, seq long, action string, payload string"))
    assert {r.row_id: r.edited for r in state.collect()} == {1: "e1", 2: None, 3: "late", 4: None}
    rows = spark.createDataFrame([(i, f"t{i}", i != 2) for i in range(1, 6)], "row_id long, tagged string, ocr_accepted boolean")
    got = {r.row_id: (r.tagged, r.adjudicated, r.accepted) for r in review.apply_adjudication(rows, state).collect()}
    assert got == {1: ("e1", True, True), 2: ("t2", False, False), 3: ("late", True, True), 4: ("t4", False, False), 5: ("t5", False, False)}
    kept = review.apply_adjudication(rows, state, include_rejected=True)
    assert {r.row_id: r.accepted for r in kept.collect()}[2] is True
