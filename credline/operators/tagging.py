"""Tagging that can stop anywhere and go on without paying for a call twice.

Results live in a store, a Parquet folder keyed by the hash of what is sent to the model (route
and text). A run calls the model once per distinct key that the store does not hold as ``ok``, in
``batches`` batches by key; every batch is one committed write, so a killed run loses at most the
batch it was in. Inside a batch each partition keeps up to ``concurrency`` calls in flight on
one model, which has to be thread-safe. Failed calls are stored with their error and tried
again by the next run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credline.functions.text import tag_all_o
from credline.operators.apply import TagModel, routed
from credline.operators.common import materialize
from credline.schemas import CHYRON, CREDITS
from credline.session import ship_package

STORE = "key string, tagged string, tag_status string, tag_error string, calls int, run long"
ARROW_STORE = pa.schema([("key", pa.string()), ("tagged", pa.string()), ("tag_status", pa.string()), ("tag_error", pa.string()),
                         ("calls", pa.int32()), ("run", pa.int64())])
SLICE = 256  # texts of a partition that are Python strings at a time


def request_key() -> Column:
    """What a call depends on: the route and the text, as one hash."""
    return F.sha2(F.concat_ws("\x1f", "route", "cleaned_text"), 256)


def tag_store(spark: SparkSession, path: str) -> DataFrame:
    """Everything called so far (empty before the first batch is committed)."""
    try:
        return spark.read.schema(STORE).parquet(path)
    except AnalysisException:  # no such folder yet
        return spark.createDataFrame([], STORE)


def _call(model: TagModel, text: str, label: str, max_retries: int, backoff_s: float) -> tuple:
    error = None
    for attempt in range(1, max_retries + 2):
        try:
            return model(text, label), "ok", None, attempt
        except Exception as e:  # noqa: BLE001 - a model failure is a row status
            error = f"{type(e).__name__}: {e}"
            if attempt <= max_retries:
                time.sleep(backoff_s)
    return None, "failed", error, max_retries + 1


def _calls(model_factory: Callable[[], TagModel], concurrency: int, max_retries: int, backoff_s: float, run_no: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in frames:
                done = pool.map(lambda x: _call(model, *x, max_retries, backoff_s), zip(pdf["cleaned_text"], pdf["route"]))
                tagged, status, errors, calls = zip(*done) if len(pdf) else ((), (), (), ())
                yield pd.DataFrame({"key": pdf["key"], "tagged": pd.Series(tagged, dtype=object), "tag_status": pd.Series(status, dtype=object),
                                    "tag_error": pd.Series(errors, dtype=object), "calls": pd.Series(calls, dtype="int32"), "run": run_no})
    return run


def _sliced(step):
    """``step`` over Arrow batches, which hold as many rows as Spark likes, ``SLICE`` rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (b.slice(at, SLICE).to_pandas() for b in batches for at in range(0, b.num_rows, SLICE))
        for out in step(frames):
            yield pa.RecordBatch.from_pandas(out, schema=ARROW_STORE, preserve_index=False)
    return run


def pending(rows: DataFrame, store: str) -> DataFrame:
    """key, route, cleaned_text: what the model has still to be called for, once per distinct key.
    A text that many rows share is one row before the shuffle."""
    wanted = (routed(rows).filter(F.col("route").isin(CHYRON, CREDITS)).withColumn("key", request_key())
              .select("key", "route", "cleaned_text").dropDuplicates(["key"]))
    done = tag_store(rows.sparkSession, store).filter("tag_status = 'ok'").select("key")
    return wanted.join(done, "key", "left_anti")


def call_pending(rows: DataFrame, model_factory: Callable[[], TagModel], store: str, batches: int = 16, concurrency: int = 8,
                 max_retries: int = 3, backoff_s: float = 1.0, stop_after: int | None = None) -> int:
    """Call the model for everything pending and commit the results batch by batch; at most
    ``stop_after`` batches. Returns the number of batches that were committed."""
    spark = rows.sparkSession
    ship_package(spark)
    todo = materialize(pending(rows, store).withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int")), "to-tag")
    left = sorted(r["batch"] for r in todo.select("batch").distinct().collect())  # at most ``batches`` numbers
    run_no = tag_store(spark, store).agg(F.coalesce(F.max("run") + 1, F.lit(0))).first()[0]
    step = _calls(model_factory, concurrency, max_retries, backoff_s, run_no)
    for i in left[:stop_after]:
        todo.filter(F.col("batch") == i).drop("batch").mapInArrow(_sliced(step), STORE).write.mode("append").parquet(store)
    return len(left[:stop_after])


def tagged_rows(rows: DataFrame, store: str) -> DataFrame:
    """Every routable row with what the store knows: input columns + route, tagged, tag_status
    (``ok``, ``failed``, ``pending``, ``rejected`` or ``unroutable``), tag_error, calls (made for its
    text so far). Rejected rows are tagged in the JVM and never reach the model."""
    r = routed(rows).withColumn("_key", request_key())
    known = tag_store(rows.sparkSession, store)
    rank = F.struct((F.col("tag_status") == "ok").alias("ok"), "run")
    known = known.groupBy(F.col("key").alias("_key")).agg(
        F.max_by(F.struct("tagged", "tag_status", "tag_error"), rank).alias("_last"), F.sum("calls").cast("long").alias("calls"))
    rejected, routable = F.col("route") == "rejected", F.col("route").isin(CHYRON, CREDITS)
    joined = r.filter(routable).join(known, "_key", "left").select(
        *rows.columns, "route", F.col("_last.tagged").alias("tagged"), F.coalesce("_last.tag_status", F.lit("pending")).alias("tag_status"),
        F.col("_last.tag_error").alias("tag_error"), F.coalesce("calls", F.lit(0).cast("long")).alias("calls"))
    settled = r.filter(~routable).select(
        *rows.columns, "route", F.when(rejected, tag_all_o("cleaned_text")).alias("tagged"), F.col("route").alias("tag_status"),
        F.lit(None).cast("string").alias("tag_error"), F.lit(0).cast("long").alias("calls"))
    return settled.unionByName(joined)


def annotate_resumable(rows: DataFrame, model_factory: Callable[[], TagModel], store: str, **options) -> DataFrame:
    """``call_pending`` for all that is left, then ``tagged_rows``."""
    call_pending(rows, model_factory, store, **options)
    return tagged_rows(rows, store)
