"""Plan shapes that the scale design depends on."""

from credline.operators import common, frames
from credline.plans import queries, views
from credline.sources import tables
from tests.conftest import SF001, uncoalesced


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_index_broadcasts_only_partition_offsets(spark):
    df = spark.createDataFrame([("g", i) for i in range(50)], "guid string, frame_num long")
    plan = _plan(frames.index_frames(df))
    # the only broadcast is the offsets table, joined on the partition id; no row joins itself
    assert plan.count("BroadcastExchange") == 1 and "SortMergeJoin" not in plan
    assert "BroadcastHashJoin [_gi_pid" in plan


def test_as_of_reads_its_source_once(spark, monkeypatch):
    reads = []
    plain = views.table
    monkeypatch.setattr(views, "table", lambda *a: reads.append(a[2]) or plain(*a))
    out = queries.QUERIES["q_prev_asof"](spark, SF001)
    plan = _plan(out)
    # the source is read while the range-partitioned rows are written; the plan reads these
    assert reads == ["orders"] and "orders.parquet" not in plan
    # the rows shuffle once, by (key, partition); the rest is one row per key or partition
    assert "windowspecdefinition(guid" in plan and "SortMergeJoin" not in plan


def test_prev_match_deals_one_key_over_partitions(spark):
    df = spark.createDataFrame([("g", i, i % 3 == 0) for i in range(400)], "guid string, frame_num long, ok boolean")
    with uncoalesced(spark):
        rows = common._ranged(df, ["guid", "frame_num"], "t", "pid")
    sizes = [r["count"] for r in rows.groupBy("pid").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 150


def test_stage_filter_prunes_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "1-ocr-in-progress"), (2, "4-llm-complete"), (3, "4-llm-complete")], "row_id long, stage string")
    tables.write_stages(df, str(tmp_path / "t"), "a")
    got = tables.read_stage(spark, str(tmp_path / "t"), "4-llm-complete")
    assert sorted(r.row_id for r in got.collect()) == [2, 3]
    plan = _plan(got)
    assert "(stage#" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_bucketed_tables_join_without_exchange(spark):
    from credline.plans.queries import QUERIES
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["q_box_bucketed"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Join" in plan and "Exchange" not in plan


def test_spread_deals_texts_by_the_callers_setting(spark):
    from credline.plans import views as V
    assert "Exchange" not in V.documents(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(V.SPREAD, "5")
    try:
        plan = V.documents(spark, SF001).select("doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(V.SPREAD)
    assert "hashpartitioning(doc_id" in plan and ", 5)" in plan and "n_chars" not in plan.split("ReadSchema")[-1]
