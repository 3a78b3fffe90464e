"""Apply user-supplied models: the tagger (text -> tagged text) and OCR (image -> boxes).

Cheap rows never reach Python: rows whose OCR was rejected are tagged ``@O`` in the JVM,
only the rest go through ``mapInPandas``. The model is created once per partition, every
call is retried a bounded number of times, and each row gets a status.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credline.functions.text import tag_all_o
from credline.operators.common import materialize
from credline.operators.frames import parse_frame_name
from credline.schemas import CHYRON, CREDITS, OCR_BOX
from credline.session import ship_package

TagModel = Callable[[str, str], str]


def route() -> Column:
    """Where a row goes: ``rejected`` (tag all-O, no model call), ``chyron`` /
    ``credits`` (model with the matching request template) or ``unroutable``."""
    return (F.when(F.col("ocr_accepted") == F.lit(False), F.lit("rejected"))
            .when(F.col("scene_label") == CHYRON, F.lit(CHYRON))
            .when(F.col("scene_label") == CREDITS, F.lit(CREDITS))
            .otherwise(F.lit("unroutable")))


def routed(df: DataFrame) -> DataFrame:
    """Drop rows without cleaned text (empty counts as missing after a stage file) and
    add the route."""
    return df.filter(F.col("cleaned_text") != "").withColumn("route", route())


def with_request(df: DataFrame, templates: Mapping[str, str], text: str = "cleaned_text") -> DataFrame:
    """Add ``request``: the user's template of the row's route with ``{text}`` replaced by
    the row's text; NULL for a route without template."""
    request = F.lit(None).cast("string")
    for name, template in templates.items():
        head, _, tail = template.partition("{text}")
        request = F.when(F.col("route") == name, F.concat(F.lit(head), F.col(text), F.lit(tail))).otherwise(request)
    return df.withColumn("request", request)


def _tag_partitions(model_factory: Callable[[], TagModel], max_retries: int, backoff_s: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for pdf in batches:
            tagged, status, errors = [], [], []
            for text, label in zip(pdf["cleaned_text"], pdf["route"]):
                out, error = None, None
                for attempt in range(max_retries + 1):
                    try:
                        out, error = model(text, label), None
                        break
                    except Exception as e:  # noqa: BLE001 - a model failure is a row status
                        error = f"{type(e).__name__}: {e}"
                        if attempt < max_retries:
                            time.sleep(backoff_s)
                tagged.append(out)
                status.append("ok" if error is None else "failed")
                errors.append(error)
            yield pdf.assign(tagged=tagged, tag_status=status, tag_error=errors)
    return run


def annotate(df: DataFrame, model_factory: Callable[[], TagModel], max_retries: int = 3,
             backoff_s: float = 1.0) -> DataFrame:
    """Tag every routable row. Output: input columns + route, tagged, tag_status (``ok``,
    ``rejected``, ``unroutable`` or ``failed``) and tag_error (the last error of a failed
    row). Two branches: rows settled in the JVM, rows for the model; the rows are written once
    before, so that neither branch nor filter derives their texts again."""
    r = routed(materialize(df, "to-tag"))
    rejected = F.col("route") == "rejected"
    settled = (r.filter(F.col("route").isin("rejected", "unroutable"))
               .withColumn("tagged", F.when(rejected, tag_all_o("cleaned_text")))
               .withColumn("tag_status", F.col("route"))
               .withColumn("tag_error", F.lit(None).cast("string")))
    ship_package(df.sparkSession)
    todo = r.filter(F.col("route").isin(CHYRON, CREDITS))
    schema = T.StructType(todo.schema.fields + [T.StructField(c, T.StringType()) for c in ("tagged", "tag_status", "tag_error")])
    return settled.unionByName(todo.mapInPandas(_tag_partitions(model_factory, max_retries, backoff_s), schema))


# --------------------------------------------------------------------------- OCR
OcrModel = Callable[[bytes], list]

OCR_OUT = T.StructType([
    T.StructField("guid", T.StringType()),
    T.StructField("frame_num", T.LongType()),
    T.StructField("boxes", T.ArrayType(OCR_BOX)),
])


def _ocr_partitions(model_factory: Callable[[], OcrModel]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for pdf in batches:
            boxes = []
            for content in pdf["content"]:
                boxes.append([{"bbox": [{"x": float(x), "y": float(y)} for x, y in b[0]],
                               "text": str(b[1]), "confidence": float(b[2])}
                              for b in model(bytes(content))])
            yield pd.DataFrame({"guid": pdf["guid"], "frame_num": pdf["frame_num"], "boxes": boxes})
    return run


def ocr_frames(frames: DataFrame, model_factory: Callable[[], OcrModel]) -> DataFrame:
    """Run an OCR model over frame images read with the ``binaryFile`` source
    (columns path, content). A model returns (4 points, text, confidence) per box."""
    ship_package(frames.sparkSession)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    guid, frame = parse_frame_name(name)
    src = frames.select(guid.alias("guid"), frame.alias("frame_num"), "content")
    return src.mapInPandas(_ocr_partitions(model_factory), OCR_OUT)
