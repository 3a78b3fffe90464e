"""Hot keys: one key holds half of all rows. Results must stay whole and exact, and the
hot key's per-key work must be split over several window partitions."""

import random

from pyspark.sql import functions as F

from credline.operators import batch, common, frames, review
from tests.conftest import uncoalesced


def _skewed_frames(spark, n=3000, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 2 == 0 else f"g{rnd.randrange(200)}"
        rows.append((g, i, rnd.random() < 0.6))
    return rows, spark.createDataFrame(rows, "guid string, frame_num long, ok boolean")


def test_prev_match_and_rank_on_hot_key(spark):
    rows, df = _skewed_frames(spark)
    with uncoalesced(spark):
        pieces = common._ranged(df, ["guid", "frame_num"], "t", "pid").filter("guid = 'hot'").groupBy("pid").count().collect()
        assert len(pieces) > 2 and max(r["count"] for r in pieces) < 1000  # the hot guid is cut by its rows
        got = {(r.guid, r.frame_num): r.p for r in common.prev_match(
            df, "guid", "frame_num", {"p": (F.col("ok"), False)}).collect()}
        rk = {(r.guid, r.frame_num): r.o for r in common.rank_within(df, "guid", "frame_num", "o").collect()}
    last = {}
    for g, f, ok in sorted(rows, key=lambda r: (r[0], r[1])):
        assert got[(g, f)] == last.get(g), (g, f)
        if ok:
            last[g] = f
    hot = sorted(f for g, f, _ in rows if g == "hot")
    assert [rk[("hot", f)] for f in hot] == list(range(len(hot)))


def test_keep_first_on_hot_text(spark):
    rnd = random.Random(8)
    rows = [(i, "g", "chyron", "SAME TEXT" if i % 3 == 0 else f"t{rnd.randrange(500)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, guid string, scene_label string, textdocument string")
    got = sorted(r.row_id for r in batch.dedupe(df, "textdocument", "row_id").collect())
    first = {}
    for rid, _, _, t in rows:
        first.setdefault(t, rid)
    assert got == sorted(first.values())


def test_review_fold_on_hot_row(spark):
    rnd = random.Random(2)
    acts = ["reject", "swap", "delete", "submit", "undo"]
    ev = [(0 if i % 2 == 0 else rnd.randrange(1, 50), i, rnd.choice(acts)) for i in range(4000)]
    df = spark.createDataFrame(ev, "row_id long, seq long, action string")
    from tests.test_review import _replay
    got = {r.row_id: (r.label_adjusted, r.deleted, r.annotated, r.ocr_accepted)
           for r in review.fold_review(df).collect()}
    assert got == _replay(ev)


def test_global_index_on_skewed_keys(spark):
    rows, df = _skewed_frames(spark, n=2000)
    idx = {(r.guid, r.frame_num): r.frame_idx for r in frames.index_frames(df.repartition(13)).collect()}
    order = sorted((g, f) for g, f, _ in rows)
    assert [idx[k] for k in order] == list(range(len(order)))


def test_review_fold_deals_a_hot_row(spark):
    """The joins of the fold are keyed by (row, salt): no task reads a hot row's whole log."""
    df = spark.createDataFrame([(0, i, "reject") for i in range(4000)] + [(0, 4001, "submit")], "row_id long, seq long, action string")
    plan = review.fold_review(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(row_id") and "_salt" in plan
    salted = df.select(F.pmod("seq", F.lit(review.SALT)).alias("s")).groupBy("s").count().collect()
    assert max(r["count"] for r in salted) < 300
