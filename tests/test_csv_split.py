"""Quoted CSV read in splits: equal to the csv module wherever the file is cut."""

import csv
import os
import random
import tempfile
from contextlib import contextmanager

import pytest
from pyspark.sql import types as T

from credline.sources import csv_split as C
from credline.sources.tables import read_csv

SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("guid", T.StringType()),
                       T.StructField("time_point", T.LongType()), T.StructField("confidence", T.DoubleType())])


@contextmanager
def splits(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def write(folder, name, rows, end="\n"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


@pytest.mark.parametrize("size", [200, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_wherever_the_file_is_cut(spark, size, end):
    rnd = random.Random(size)
    text = lambda: "".join(rnd.choice('ab",é\n \r') for _ in range(rnd.choice([0, 3, 30])))
    rows = [["row_id", "note\nof two lines", "x"]] + [[str(i), text() or "-", text() or "-"] for i in range(60)]
    rows[30][1] = "long\n" * 300
    folder = tempfile.mkdtemp(prefix="credline-csv-")
    write(folder, "a.csv", rows, end)
    write(folder, "b.csv", rows[:7], end)
    with splits(spark, str(size)):
        got = C.records(spark, folder).orderBy("file", "block", "rec").collect()
    for name, want in (("a.csv", rows), ("b.csv", rows[:7])):
        own = [r.record for r in got if r.file.endswith(name)]
        assert [next(csv.reader(r.splitlines(keepends=True))) if r else [] for r in own] == want


def test_bad_records_are_set_aside(spark):
    folder = tempfile.mkdtemp(prefix="credline-csv-")
    write(folder, "a.csv", [["row_id", "guid", "timePoint", "confidence"], ["1", "a\nb", "5", "0.5"], ["2", "x", "soon", "1"],
                            ["3", "short"], ["4", "y", "", ""], ["5", "z", "7", "high"], ["6", "w", "8", "1", "extra"]])
    write(folder, "b.csv", [["guid", "other", "row_id"], ['q"q', "o", "9"], ["q", "o", "1.5"]])
    with splits(spark, "60"):
        rows, bad = C.read_csv_checked(spark, folder, SCHEMA)
        got = sorted(map(tuple, rows.select("row_id", "guid", "time_point", "confidence", "other").collect()))
        off = sorted((r.file.rsplit("/", 1)[1], r.record, r.reason) for r in bad.collect())
    assert got == [(1, "a\nb", 5, 0.5, None), (4, "y", None, None, None), (9, 'q"q', None, None, "o")]
    assert off == [("a.csv", "2,x,soon,1", "time_point is no bigint: soon"), ("a.csv", "3,short", "not 4 fields"),
                   ("a.csv", "5,z,7,high", "confidence is no double: high"), ("a.csv", "6,w,8,1,extra", "not 4 fields"),
                   ("b.csv", "q,o,1.5", "row_id is no bigint: 1.5")]


def test_one_large_file_is_read_in_many_tasks(spark):
    folder = tempfile.mkdtemp(prefix="credline-csv-")
    write(folder, "a.csv", [["row_id", "guid", "time_point", "confidence"], *([str(i), "g\n" * 20, "1", "1.0"] for i in range(4_000))])
    with splits(spark, "20000"):
        recs = C.records(spark, folder)
        assert recs.select("block").distinct().count() > 8
        rows, bad = C.read_csv_checked(spark, folder, SCHEMA)
        assert rows.count() == 4_000 and bad.isEmpty() and rows.agg({"row_id": "sum"}).first()[0] == sum(range(4_000))


def test_headers_read_only_the_first_record(spark):
    """Columns go by name also where a header holds a quoted line break; empty files are skipped."""
    folder = tempfile.mkdtemp(prefix="credline-csv-")
    write(folder, "a.csv", [["row_id", "two\nlines", "timepoint"], ["1", "x", "2"]])
    write(folder, "b.csv", [["timePoint", "row_id"], ["4", "3"]])
    open(f"{folder}/c.csv", "w").close()
    got = read_csv(spark, folder, SCHEMA)
    assert sorted(tuple(r) for r in got.select("row_id", "two\nlines", "time_point").collect()) == [(1, "x", 2), (3, None, 4)]
    assert C.read_csv_checked(spark, tempfile.mkdtemp(prefix="credline-csv-"), SCHEMA)[0].count() == 0


def test_an_empty_folder_gives_an_empty_table(spark):
    assert read_csv(spark, tempfile.mkdtemp(prefix="credline-csv-"), SCHEMA).schema == SCHEMA
