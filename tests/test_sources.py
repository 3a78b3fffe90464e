"""Stage tables, path dimension, frame listing + OCR surface, tagger surface, stage hop."""

import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from credline.operators import apply, boxes
from credline.schemas import OCR_ROW, REVIEWED_ROW
from credline.sources import files, tables
from credline.streaming import incremental


def test_csv_roundtrip_keeps_awkward_text(spark):
    texts = ["plain", "multi\nline", "  outer blanks  ", 'quote " and ""double""', "crlf\r\nline",
             "back\\slash", "NA"]
    rows = [(f"g{i}", i, "chyron", 0.5, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, OCR_ROW)
    path = os.path.join(tempfile.mkdtemp(prefix="credline-csv-"), "t")
    tables.write_csv(df, path, time_header="timePoint")
    back = tables.read_csv(spark, path)
    assert "time_point" in back.columns
    assert sorted(back.collect()) == sorted(df.collect())


def test_path_dim_later_file_overrides(spark):
    d = tempfile.mkdtemp(prefix="credline-paths-")
    for name, body in [("a_paths.csv", "guid,path\ng1,/old\ng2,/two\n"), ("b_paths.csv", "guid,path\ng1,/new\n")]:
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    from credline.operators.review import latest_paths
    got = {r.guid: r.path for r in latest_paths(files.read_path_dim(spark, os.path.join(d, "*paths.csv"))).collect()}
    assert got == {"g1": "/new", "g2": "/two"}


def test_frame_listing_and_ocr_surface(spark):
    d = tempfile.mkdtemp(prefix="credline-frames-")
    for name in ["cpb-aacip-1-x.0015.png", "cpb-aacip-1-x.30.png", "cpb-aacip-2-y.7.png", "notes.txt"]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(name.encode())
    listed = files.list_frames(spark, d)
    assert sorted((r.guid, r.frame_num) for r in listed.collect()) == [
        ("cpb-aacip-1-x", 15), ("cpb-aacip-1-x", 30), ("cpb-aacip-2-y", 7)]

    def factory():
        def model(content: bytes):
            n = len(content)
            return [([[0, 0], [n, 0], [n, 2.9], [0, 2.9]], content.decode()[:5], 0.9),
                    ([[1.5, 1], [2, 1], [2, 3], [1, 3]], "x", float("nan"))]
        return model

    res = apply.ocr_frames(files.list_frames(spark, d, with_content=True), factory)
    ex = boxes.explode_boxes(res)
    cs = boxes.corners("bbox")
    rows = ex.select("guid", "frame_num", "box_pos", cs["x2"].alias("x2"), cs["y2"].alias("y2"),
                     boxes.confidence_tier("confidence").alias("tier")).collect()
    assert len(rows) == 6
    assert {r.tier for r in rows if r.box_pos == 1} == {"low"}
    assert {(r.box_pos, r.y2) for r in rows} == {(0, 2), (1, 3)}


def test_tagger_surface_routes_and_retries(spark):
    df = spark.createDataFrame(
        [(1, True, "chyron", "Jane Doe Anchor"), (2, False, "credits", "a b"), (3, True, "other", "x y"),
         (4, True, "credits", ""), (5, True, "credits", "boom")],
        "row_id long, ocr_accepted boolean, scene_label string, cleaned_text string")

    def factory():
        def model(text, label):
            if text == "boom":
                raise RuntimeError("service down")
            return " ".join(f"{w}@O" for w in text.split()) + f" #{label}"
        return model

    got = {r.row_id: (r.route, r.tag_status, r.tagged, r.tag_error) for r in
           apply.annotate(df, factory, max_retries=2, backoff_s=0.0).collect()}
    assert got == {1: ("chyron", "ok", "Jane@O Doe@O Anchor@O #chyron", None), 2: ("rejected", "rejected", "a@O b@O", None),
                   3: ("unroutable", "unroutable", None, None), 5: ("credits", "failed", None, "RuntimeError: service down")}
    asked = apply.with_request(apply.routed(df), {"chyron": "top {text} end", "credits": "{text}"})
    assert {r.row_id: r.request for r in asked.collect()} == {1: "top Jane Doe Anchor end", 2: None, 3: None, 5: "boom"}


def test_stage_hop_processes_each_file_once(spark):
    base = tempfile.mkdtemp(prefix="credline-hop-")
    src, sink, ckpt = (os.path.join(base, x) for x in ("src", "sink", "ckpt"))
    os.makedirs(src)
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("action", T.StringType())])

    def drop(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(base, "tmp_" + name))
        part = [f for f in os.listdir(os.path.join(base, "tmp_" + name)) if f.endswith(".parquet")][0]
        os.rename(os.path.join(base, "tmp_" + name, part), os.path.join(src, name))

    drop("a.parquet", [(1, "submit"), (2, "swap")])
    drop(".hidden.parquet", [(9, "undo")])
    drop("b.parquet.20240101.llm-annotated", [(8, "undo")])
    n1 = incremental.stage_hop(spark, src, schema, sink, ckpt, lambda d: d.withColumn("hop", F.lit(1)))
    assert n1 == 2
    drop("c.parquet", [(3, "delete")])
    n2 = incremental.stage_hop(spark, src, schema, sink, ckpt, lambda d: d.withColumn("hop", F.lit(1)))
    assert n2 == 1
    assert incremental.stage_hop(spark, src, schema, sink, ckpt) == 0
    assert sorted(r.row_id for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_csv_with_row_number_index(spark):
    df = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "row_id long, t string").repartition(3)
    path = os.path.join(tempfile.mkdtemp(prefix="credline-idx-"), "t")
    tables.write_with_index(df, path, "row_id")
    back = spark.read.options(**tables.CSV_OPTIONS).schema("index long, row_id long, t string").csv(path)
    assert sorted((r["index"], r.row_id, r.t) for r in back.collect()) == [(0, 10, "a"), (1, 20, "b"), (2, 30, "c")]


def test_stage_table_keeps_other_batches(spark, tmp_path):
    path = str(tmp_path / "stages")
    rows = lambda *ids: spark.createDataFrame([(i, "1-ocr-in-progress") for i in ids], "row_id long, stage string")
    tables.write_stages(rows(1, 2), path, "a")
    tables.write_stages(rows(3), path, "b")
    assert sorted((r.row_id, r.batch) for r in tables.read_stage(spark, path).collect()) == [(1, "a"), (2, "a"), (3, "b")]
    tables.write_stages(rows(4), path, "b")  # the batch again
    assert sorted(r.row_id for r in tables.read_stage(spark, path).collect()) == [1, 2, 4]


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('guid,timepoint,scene_label,confidence,textdocument\ng1,7,chyron,0.5,"two\nlines"\n')
    (tmp_path / "b.csv").write_text("textdocument,timePoint,guid,scene_label,deleted\nplain,8,g2,credits,true\n")
    got = {r.guid: r for r in tables.read_csv(spark, str(tmp_path), REVIEWED_ROW).collect()}
    assert (got["g1"].time_point, got["g1"].scene_label, got["g1"].textdocument, got["g1"].deleted) == (7, "chyron", "two\nlines", None)
    assert (got["g2"].time_point, got["g2"].scene_label, got["g2"].confidence, got["g2"].deleted) == (8, "credits", None, True)


def test_last_path_of_a_file_wins(spark, tmp_path):
    for folder, body in (("1", "g1,/a\ng2,/b\ng1,/c\n"), ("2", "g2,/d\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "my_paths.csv").write_text("guid,path\n" + body)  # two folders, one file name
    from credline.operators.review import latest_paths
    got = {r.guid: r.path for r in latest_paths(files.read_path_dim(spark, str(tmp_path / "*" / "*paths.csv"))).collect()}
    assert got == {"g1": "/c", "g2": "/d"}


def test_hop_counts_more_batches_than_spark_reports(spark, tmp_path):
    schema = T.StructType([T.StructField("row_id", T.LongType())])
    src = tmp_path / "src"
    spark.range(120).select(F.col("id").alias("row_id")).repartition(120, "row_id").write.option("maxRecordsPerFile", 1).parquet(str(src))
    args = (spark, str(src), schema, str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    assert incremental.stage_hop(*args, max_files_per_batch=1) == 120
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 120


def test_csv_stage_hop(spark, tmp_path):
    df = spark.createDataFrame([("g1", 1, "chyron", 0.5, "a\nb"), ("g2", 2, "credits", 0.1, 'c "d"')], OCR_ROW)
    tables.write_csv(df, str(tmp_path / "in"), time_header="time_point")
    n = incremental.stage_hop(spark, str(tmp_path / "in"), OCR_ROW, str(tmp_path / "out"), str(tmp_path / "ckpt"), glob="*.csv", fmt="csv",
                              options=tables.CSV_OPTIONS)
    assert n == 2 and sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(df.collect())


def test_scratch_is_one_folder_and_goes(spark, tmp_path):
    import os

    from credline import session
    with session.scratch_run(spark) as root:
        path = session.scratch_path(spark, "x")
        assert path.startswith(root)
        spark.range(3).write.parquet(path)
        local = path.removeprefix("file:")
        assert os.path.isdir(local)
    assert not os.path.exists(local)
