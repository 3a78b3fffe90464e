"""Stage hops that fail and go on, and hops that archive what they have read."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credline.streaming.incremental import stage_hop

SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("text", T.StringType())])


def drop(spark, folder, name, ids):
    spark.createDataFrame([(i, f"t{i}") for i in ids], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def test_a_hop_that_fails_in_its_second_batch_goes_on(spark):
    """The first batch is committed, the second breaks off after some of its rows were written; the
    next pass takes up the second batch and every row arrives once."""
    base = tempfile.mkdtemp(prefix="credline-hop-")
    src, sink, ckpt = (f"{base}/{x}" for x in ("src", "sink", "ckpt"))
    for i in range(3):
        drop(spark, src, f"d{i}", range(10 * i, 10 * i + 10))
        time.sleep(0.02)  # files are taken in the order of their times
    bad = lambda df: df.withColumn("text", F.when(F.col("row_id") == 15, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        stage_hop(spark, src, SCHEMA, sink, ckpt, bad, max_files_per_batch=1)
    assert sorted(r.row_id for r in spark.read.parquet(sink).collect()) == list(range(10))
    assert stage_hop(spark, src, SCHEMA, sink, ckpt, max_files_per_batch=1) == 20
    assert sorted(r.row_id for r in spark.read.parquet(sink).collect()) == list(range(30))
    assert stage_hop(spark, src, SCHEMA, sink, ckpt, max_files_per_batch=1) == 0


def test_a_hop_archives_what_it_has_read(spark):
    base = tempfile.mkdtemp(prefix="credline-hop-")
    src, sink, ckpt, archive = (f"{base}/{x}" for x in ("in/src", "sink", "ckpt", "done"))
    os.makedirs(archive)
    got = 0
    for i in range(4):
        drop(spark, src, f"d{i}", range(10 * i, 10 * i + 10))
        got += stage_hop(spark, src, SCHEMA, sink, ckpt, archive_dir=archive)
    assert got == 40 and sorted(r.row_id for r in spark.read.parquet(sink).collect()) == list(range(40))
    moved = files(archive)  # a batch's files move when a later one is committed
    assert moved and not set(os.path.basename(f) for f in moved) & set(os.path.basename(f) for f in files(src))
    assert len(moved) + len(files(src)) == 4
    back = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(archive)
    assert set(r.row_id for r in back.collect()) <= set(range(40))


def test_a_second_archive_pass_reads_nothing_again(spark):
    base = tempfile.mkdtemp(prefix="credline-hop-")
    src, sink, ckpt, archive = (f"{base}/{x}" for x in ("in/src", "sink", "ckpt", "done"))
    os.makedirs(archive)
    drop(spark, src, "d", range(5))
    assert [stage_hop(spark, src, SCHEMA, sink, ckpt, archive_dir=archive) for _ in range(3)] == [5, 0, 0]
