"""Stage tables: CSV for exchange with the outside, Parquet between stages."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credline.operators.common import global_index
from credline.schemas import OCR_ROW, STAGES
from credline.session import ship_package

# Header spellings of the time column seen in stage files.
TIME_ALIASES = ("timePoint", "timepoint", "time_point")

# CSV options that carry quoted multi-line text, outer blanks and CRLF unchanged.
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "escape": '"',
    "quote": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str, time_header: str = "timepoint") -> None:
    """Write a stage table as CSV with a header (no index column)."""
    out = df.withColumnRenamed("time_point", time_header) if "time_point" in df.columns else df
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def _first_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first record of each file, of which no more than that is read."""
    from pyarrow import fs

    def first(path: str) -> str:
        files, name = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and path[6:7] != "/" else path)
        text = b""
        with files.open_input_stream(name) as f:
            while block := f.read(8192):
                text += block
                at = -1
                while (at := text.find(b"\n", at + 1)) >= 0:
                    if text.count(b'"', 0, at) % 2 == 0:
                        return text[:at].decode().rstrip("\r")
        return text.decode()

    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "header": [first(p) for p in pdf["path"]]})


def _headers(spark: SparkSession, path: str) -> list[tuple[str, str | list[str]]]:
    """(header record, its files) of the CSV files of a path. The driver gets one row per
    different header, and file names only where headers differ."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path")  # a listing: no content is read
    first = files.mapInPandas(_first_records, "path string, header string").filter("header <> ''")
    found = sorted(r["header"] for r in first.select("header").distinct().collect())
    if len(found) < 2:
        return [(h, path) for h in found]
    return [(r["header"], sorted(r["fs"])) for r in first.groupBy("header").agg(F.collect_list("path").alias("fs")).orderBy("header").collect()]


def read_csv(spark: SparkSession, path: str, schema: T.StructType = OCR_ROW) -> DataFrame:
    """Read stage CSV files with explicit types. The time column may be spelled either way;
    columns go by name, so the files of a folder may differ in the order or the set of their
    columns (a column that a file lacks is NULL there); columns unknown to ``schema`` are
    strings. ``multiLine`` files are one task each: keep them to the size of an exchange batch, or
    use ``csv_split.read_csv_checked``, which reads them in splits and sets bad records aside."""
    known = {f.name: f.dataType for f in schema.fields}
    out = None
    for header, files in _headers(spark, path):
        names = next(csv.reader(header.splitlines(keepends=True)))
        canon = ["time_point" if n in TIME_ALIASES else n for n in names]
        fields = [T.StructField(c, known.get(c, T.StringType())) for c in canon]
        part = spark.read.options(**CSV_OPTIONS).option("enforceSchema", "true").schema(T.StructType(fields)).csv(files)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], schema) if out is None else out


def write_with_index(df: DataFrame, path: str, order: str) -> None:
    """CSV with a leading 0-based row number column (ordered by ``order``)."""
    global_index(df, [order], "index").select("index", *df.columns).write.mode("overwrite") \
        .options(**CSV_OPTIONS).csv(path)


def write_stages(df: DataFrame, path: str, batch: str, stage_col: str = "stage") -> None:
    """Add the rows of one batch to the stage table, a folder per (stage, batch). Nothing of
    other batches is touched; writing a batch again replaces that batch's rows only."""
    (df.withColumn("batch", F.lit(batch)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(stage_col, "batch").parquet(path))


def read_stage(spark: SparkSession, path: str, stage: str | None = None) -> DataFrame:
    """Read the stage table, optionally one stage only (partition pruning)."""
    df = spark.read.parquet(path)
    if stage is not None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        df = df.filter(F.col("stage") == stage)
    return df
