"""Incremental gold snapshot: equal to a full fold, and only touched buckets are rewritten."""

import os
import random
import tempfile

from credline.operators.frames import last_write
from credline.sources import gold_store as G

SCHEMA = "guid string, frame_num long, seq long, bindings map<string,array<string>>, meta map<string,string>"


def saves(n, seq0, seed, guids=("a", "b", "c"), frames=400):
    rnd = random.Random(seed)
    return [(rnd.choice(guids), rnd.randrange(frames), seq0 + i, {"role": [f"x{seq0 + i}"]}, {"_image_id": "i"}) for i in range(n)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def view(df):
    return sorted((r.guid, r.frame_num, r.seq, str(r.bindings)) for r in df.collect())


def test_batches_equal_a_full_fold(spark):
    path = tempfile.mkdtemp(prefix="credline-gold-") + "/store"
    log = []
    for i in range(3):
        batch = saves(150, 1000 * i, i)
        log += batch
        G.upsert(spark.createDataFrame(batch, SCHEMA), path, buckets=8, frames_a_run=50)
    full = last_write(spark.createDataFrame(log, SCHEMA), ["guid", "frame_num"], "seq", ["bindings", "meta"])
    assert view(G.read_snapshot(spark, path)) == view(full)


def test_a_batch_rewrites_only_its_buckets(spark):
    path = tempfile.mkdtemp(prefix="credline-gold-") + "/store"
    G.upsert(spark.createDataFrame(saves(600, 0, 1), SCHEMA), path, buckets=16, frames_a_run=50)
    before = files(path)
    touched = G.upsert(spark.createDataFrame([("a", 7, 5000, {"new": ["y"]}, {})], SCHEMA), path, buckets=16, frames_a_run=50)
    after = files(path)
    gone = {f.split("bucket=")[1].split("/")[0] for f in before if f not in after}
    assert len(touched) == 1 and gone == {str(touched[0])} and len(before) > 4
    assert all(after[f] == at for f, at in before.items() if f in after)
    assert G.read_snapshot(spark, path).filter("guid = 'a' and frame_num = 7").first().bindings == {"new": ["y"]}


def test_late_and_repeated_saves_change_nothing(spark):
    path = tempfile.mkdtemp(prefix="credline-gold-") + "/store"
    batch = spark.createDataFrame(saves(50, 100, 4), SCHEMA)
    G.upsert(batch, path, buckets=4)
    before, state = files(path), view(G.read_snapshot(spark, path))
    old = spark.createDataFrame([("a", r.frame_num, 1, {"old": []}, {}) for r in G.read_snapshot(spark, path).filter("guid = 'a'").collect()], SCHEMA)
    assert G.upsert(batch, path, buckets=4) == [] and G.upsert(old, path, buckets=4) == []
    assert files(path) == before and view(G.read_snapshot(spark, path)) == state


def test_a_long_guid_spreads_over_buckets(spark):
    rows = spark.range(100_000).selectExpr("'g' as guid", "id as frame_num")
    n = rows.withColumn("bucket", G.bucket(64, 100)).groupBy("bucket").count().collect()
    assert len(n) == 64 and max(r["count"] for r in n) < 4 * 100_000 / 64
