"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credline.session import scratch_path, ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` and, where SQL can express it,
    its DuckDB oracle."""
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder below ``spark.checkpoint.dir`` and read it back: the
    lineage is cut and a lost executor costs no upstream work."""
    path = scratch_path(df.sparkSession, name)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_python(df: DataFrame) -> DataFrame:
    """Call before a Python stage: makes the package importable in the workers."""
    ship_package(df.sparkSession)
    return df


def partition_id() -> int:
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def fold(id_col: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 4 (null for a null id). Rows with 2 are held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4))


def held_out(id_col: str | Column = "doc_id") -> Column:
    return F.coalesce(fold(id_col) == 2, F.lit(False))


def row_key(id_col: str, text_col: str) -> Column:
    """A hash by which a row's results find it again: equal for rows of equal id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def wide_key(id_col: str, text_col: str) -> Column:
    """A 128-bit row key for results that change or drop the row they find again: equal for rows of
    equal id and text; others do not meet by chance in any table that can be stored."""
    text = F.col(text_col).cast("string")
    marked = F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), text))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), marked).cast("binary")))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
