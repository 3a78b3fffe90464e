"""Quoted CSV read in splits, with the records that do not parse set aside.

A quoted field may hold line breaks, so a reader that cuts a file anywhere cannot tell by
itself whether it starts inside quotes; Spark's ``multiLine`` reader therefore takes a file as
one task. Here the text source cuts the files into splits of lines, and quote parity finds the
records: a line starts one if the number of quotes before it in its file is even. That number is
one sum per split, a running sum over the splits of a file (one row a split), and a count along
the lines of the split, which one task reads in order. Every record is put together there, so
texts do not shuffle; only the pieces of records that cross a split meet again.

Records are parsed by ``from_csv`` with the columns of their file's header, by name. A record
with a value that is not of its column's type, or with too few or too many fields, is kept as
it stands, with its file and the reason. A stray quote in an unquoted field is not valid CSV and
shifts the parity up to the next one; its records end up among the bad ones as well.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credline.operators.common import materialize
from credline.schemas import OCR_ROW
from credline.session import ship_package
from credline.sources.tables import TIME_ALIASES

CORRUPT = "_corrupt"
OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true",
           "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from the lines (file, block, inside, value) of splits, in their order: file, block, rec,
    record. What a split holds before its first record is its piece 0."""
    split, rec, held, quoted = None, 0, [], False
    for batch in batches:
        out = []
        for file, block, inside, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if split != (file, block):
                if held:
                    out.append((*split, rec, "\n".join(held)))
                split, rec, held, quoted = (file, block), 0, [], bool(inside)
            if not quoted:
                if held:
                    out.append((file, block, rec, "\n".join(held)))
                rec, held = rec + 1, []
            held.append(value)
            quoted ^= value.count('"') % 2 == 1
        yield _batch(out)
    if held:
        yield _batch([(*split, rec, "\n".join(held))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                      names=["file", "block", "rec", "record"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, block (the split where it begins), rec (its number there, from 1), record: every
    record of the CSV files of a path, headers included, without the line break at its end."""
    ship_package(spark)
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.sum(_quotes(F.col("value")) % 2).alias("n")).select(  # one row a split
        "file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2).alias("inside"))
    lines = lines.join(F.broadcast(splits), ["file", "block"]).select("file", "block", "inside", "value")  # keeps the order
    pieces = materialize(lines.mapInArrow(_pieces, "file string, block long, rec long, record string"), "csv-records")
    # a piece 0 goes on with the last record of an earlier split
    ends = pieces.groupBy("file", "block").agg(F.max("rec").alias("last"), F.min("rec").alias("first"))  # one row a split
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owner = ends.withColumn("owner", F.max(F.when(F.col("last") > 0, F.struct("block", "last"))).over(earlier))
    tails = owner.filter((F.col("first") == 0) & F.col("owner").isNotNull())
    cut = tails.select("file", F.col("owner.block").alias("block"), F.col("owner.last").alias("rec")).distinct()
    whole = pieces.filter("rec > 0").join(F.broadcast(cut), ["file", "block", "rec"], "left_anti")
    heads = pieces.join(F.broadcast(cut), ["file", "block", "rec"]).select("file", "block", "rec", "record")
    rest = pieces.filter("rec = 0").join(F.broadcast(tails.select("file", "block", "owner")), ["file", "block"]).select(
        "file", F.col("owner.block").alias("block"), F.col("owner.last").alias("rec"), "record", F.col("block").alias("own"))
    joined = heads.withColumn("own", F.col("block")).unionByName(rest).groupBy("file", "block", "rec").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("own", "record"))), lambda x: x["record"]), "\n").alias("record"))
    return whole.select("file", "block", "rec", "record").unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def headers(recs: DataFrame) -> dict[str, list[str]]:
    """Column names by header record; what reaches the driver is one row per different header."""
    first = recs.filter("block = 0 and rec = 1").select("record").distinct().collect()
    return {r["record"]: next(csv.reader(r["record"].splitlines(keepends=True))) for r in sorted(first) if r["record"]}


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> list[tuple[list[T.StructField], DataFrame]]:
    """(columns, frame of file, record, r (the fields as text), reason) for each different header."""
    known = {f.name: f.dataType for f in schema.fields}
    recs = records(spark, path)
    first = (F.col("block") == 0) & (F.col("rec") == 1)
    heads = recs.filter(first).select("file", F.col("record").alias("header"))
    body = recs.filter(~first & (F.col("record") != ""))
    found = headers(recs)
    if len(found) > 1:
        body = body.join(heads, "file")
    out = []
    for header, names in found.items():
        canon = ["time_point" if n in TIME_ALIASES else n for n in names]
        fields = [T.StructField(c, known.get(c, T.StringType())) for c in canon]
        own = body.filter(F.col("header") == header) if len(found) > 1 else body
        ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*canon, CORRUPT])
        rows = own.select("file", "record", F.from_csv("record", ddl, OPTIONS).alias("r"))
        wrong = F.when(F.col("r")[CORRUPT].isNotNull(), F.lit(f"not {len(fields)} fields"))
        for f in fields:
            if not isinstance(f.dataType, T.StringType):
                text = F.col("r")[f.name]
                wrong = wrong.when(text.isNotNull() & text.try_cast(f.dataType).isNull(),
                                   F.concat(F.lit(f"{f.name} is no {f.dataType.simpleString()}: "), text))
        out.append((fields, rows.withColumn("reason", wrong)))
    return out


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType = OCR_ROW) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the rows of all records that parse, with columns by name as in
    ``tables.read_csv``, and file, record, reason of those with a value that is not of its
    column's type or with another number of fields. Reads files of any size in splits."""
    rows = bad = None
    for fields, part in _parsed(spark, path, schema):
        good = part.filter("reason is null").select(*[F.col("r")[f.name].try_cast(f.dataType).alias(f.name) for f in fields])
        off = part.filter("reason is not null").select("file", "record", "reason")
        rows = good if rows is None else rows.unionByName(good, allowMissingColumns=True)
        bad = off if bad is None else bad.unionByName(off)
    if rows is None:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "file string, record string, reason string")
    return rows, bad
