"""Resumable tagging: nothing is paid for twice, a killed run goes on where it stopped."""

import os
import tempfile
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from credline.operators import tagging as T
from credline.operators.apply import annotate
from credline.schemas import CHYRON, CREDITS


def rows(spark, n=60):
    data = [(i, [CHYRON, CREDITS, "slate"][i % 3], i % 7 != 0, None if i % 11 == 5 else f"text {i % 20}") for i in range(n)]
    return spark.createDataFrame(data, "row_id long, scene_label string, ocr_accepted boolean, cleaned_text string").repartition(3)


def counting(folder, fatal=None, flaky=None):
    """A model that writes a line per call; ``fatal`` texts kill their task, ``flaky`` ones fail."""
    def factory():
        def tag(text, label):
            with open(f"{folder}/{os.getpid()}-{threading.get_ident()}", "a") as f:
                f.write(f"{label}|{text}\n")
            if fatal and text in fatal:
                raise SystemExit(f"killed at {text}")
            if flaky and text in flaky:
                raise ValueError("no answer")
            return f"{text.replace(' ', '@O ')}@O"
        return tag
    return factory


def calls(folder):
    return Counter(line.strip() for name in os.listdir(folder) for line in open(f"{folder}/{name}"))


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="credline-calls-")


def test_equal_texts_are_called_once(spark, folder):
    df = rows(spark)
    out = T.annotate_resumable(df, counting(folder), f"{folder}-store", batches=4)
    n = calls(folder)
    wanted = {f"{r.scene_label}|{r.cleaned_text}" for r in df.filter("ocr_accepted and cleaned_text is not null").collect() if r.scene_label != "slate"}
    assert set(n) == wanted and set(n.values()) == {1}
    same = ["row_id", "route", "tagged", "tag_status", "tag_error"]
    want = annotate(df, counting(tempfile.mkdtemp()), 0, 0.0).select(*same)
    assert sorted(map(tuple, out.select(*same).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_second_run_calls_nothing(spark, folder):
    df = rows(spark)
    first = T.annotate_resumable(df, counting(folder), f"{folder}-store", batches=4)
    before, n = sorted(map(str, first.collect())), calls(folder)
    assert T.call_pending(df, counting(folder), f"{folder}-store", batches=4) == 0
    assert calls(folder) == n and sorted(map(str, T.tagged_rows(df, f"{folder}-store").collect())) == before


def test_a_killed_run_goes_on(spark, folder):
    """The job dies in a batch; what earlier batches paid for is kept and not called again."""
    df, store = rows(spark), f"{folder}-store"
    last = T.pending(df, store).withColumn("b", F.pmod(F.xxhash64("key"), F.lit(8))).orderBy(F.desc("b")).first()
    with pytest.raises(Exception):  # noqa: B017
        T.call_pending(df, counting(folder, fatal={last.cleaned_text}), store, batches=8, concurrency=2)
    paid = {r.key for r in T.tag_store(spark, store).collect()}
    assert paid and T.tagged_rows(df, store).filter("tag_status = 'pending'").count() > 0
    again = tempfile.mkdtemp(prefix="credline-calls-")
    T.call_pending(df, counting(again), store, batches=8)
    n = calls(again)
    assert set(n.values()) == {1}
    ran = {r.key for r in T.tag_store(spark, store).collect()}
    assert len(n) == len(ran) - len(paid)
    assert T.tagged_rows(df, store).filter("route in ('chyron', 'credits') and tag_status <> 'ok'").count() == 0


def test_failed_calls_are_tried_again(spark, folder):
    df, store = rows(spark), f"{folder}-store"
    out = T.annotate_resumable(df, counting(folder, flaky={"text 1"}), store, batches=2, max_retries=1, backoff_s=0.0)
    bad = out.filter("tag_status = 'failed'").collect()
    assert bad and {(r.cleaned_text, r.tag_error, r.calls) for r in bad} == {("text 1", "ValueError: no answer", 2)}
    out = T.annotate_resumable(df, counting(folder), store, batches=2)
    assert {(r.tag_status, r.calls) for r in out.filter("cleaned_text = 'text 1' and route in ('chyron', 'credits')").collect()} == {("ok", 3)}


def test_calls_run_side_by_side(spark, folder):
    """Eight slow calls of one partition take about as long as one."""
    def factory():
        def tag(text, label):
            time.sleep(0.5)
            return text
        return tag
    step = T._calls(factory, 8, 0, 0.0, 0)
    import pandas as pd
    pdf = pd.DataFrame({"key": list("abcdefgh"), "cleaned_text": list("abcdefgh"), "route": [CHYRON] * 8})
    t = time.time()
    out = pd.concat(step(iter([pdf])))
    assert time.time() - t < 2 and out["tagged"].tolist() == list("abcdefgh")


def test_a_large_batch_is_called_in_slices():
    """However many rows a batch of Spark's holds, few of them are Python strings at a time."""
    import pyarrow as pa

    sizes = []

    def step(frames):
        for pdf in frames:
            sizes.append(len(pdf))
            yield from T._calls(lambda: lambda text, label: text + "@O", 4, 0, 0.0, 0)(iter([pdf]))
    n = 3 * T.SLICE + 5
    batch = pa.RecordBatch.from_pydict({"key": [str(i) for i in range(n)], "route": [CHYRON] * n, "cleaned_text": [f"t{i}" for i in range(n)]})
    out = pa.Table.from_batches(list(T._sliced(step)(iter([batch, batch.slice(0, 0)]))))
    assert max(sizes) == T.SLICE and sum(sizes) == n
    assert out["key"].to_pylist() == [str(i) for i in range(n)] and out["tagged"].to_pylist() == [f"t{i}@O" for i in range(n)]
