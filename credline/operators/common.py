"""Skew-safe building blocks shared by the operators.

* ``keep_first``     keep-first distinct: partial aggregate of the winning position per key,
                     then a semi join on the (unique) position. A hot key is pre-aggregated
                     map side and never lands whole in one task.
* ``prev_match``     as-of lookup "latest earlier row of the same key whose predicate holds":
                     one range partitioning by (key, order), windows per (key, partition), and
                     a carry of one row per partition, so one huge key is cut by its rows.
* ``rank_within``    0-based position inside a key, same cutting.
* ``global_index``   0-based consecutive index: range-partitioned sort, per-partition counts
                     (one row per partition) and offsets; ties and NULLs keep their rows.
* ``materialize``    write a multi-use intermediate once as Parquet to the shared folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credline.session import scratch_path


def _cols(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    For an intermediate that several branches of a plan consume: it is computed a single
    time, its lineage is cut (a lost executor does not recompute the upstream), and every
    branch reads only the columns it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: str) -> DataFrame:
    """Keep, per key, the row with the smallest ``order`` (``order`` must be unique)."""
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    winners = df.groupBy(*key_cols).agg(F.min(order).alias(order)).select(order)
    return df.join(winners, order, "left_semi")


def _ranged(df: DataFrame, cols: Sequence[str], name: str, pid: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``cols`` (equal values never part), written once,
    with the number of each row's partition: a key of any size is cut into bounded pieces by
    its rows, whatever its values. The only pass over ``df`` apart from the range sample."""
    s = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn(pid, F.spark_partition_id())
    return materialize(s, name)


def prev_match(df: DataFrame, keys, order: str, targets: Mapping[str, tuple]) -> DataFrame:
    """Add one column per target: the largest ``order`` of a row of the same key whose
    condition holds and whose ``order`` is below (``inclusive=False``) or at most
    (``inclusive=True``) the current one. Rows of equal ``order`` do not count as earlier;
    NULL keys form a key of their own.

    A target is ``(cond, inclusive)`` or ``(cond, inclusive, payload_cols)``; with payload
    columns the output is a struct ``(order, *payload)`` of the matched row, so the
    matched row's values come along without a join back.

    Plan: the rows are range-partitioned by (key, order) once. Windows run per (key,
    partition); a key can only reach into the next partition as that partition's first key,
    so the carry is one row per partition, which bounds its broadcast.
    """
    keys = _cols(keys)
    pid = "_pm_pid"
    base, specs = df, {}
    for out, t in targets.items():
        payload = list(t[2]) if len(t) > 2 else []
        val = (F.struct(F.col(order).alias(order), *[F.col(c).alias(c) for c in payload])
               if payload else F.col(order))
        base = base.withColumn(f"_pm_c_{out}", F.when(t[0], val))
        specs[out] = t[1]
    rows = _ranged(base, [*keys, order], "asof", pid)
    key = F.struct(*keys)
    per_key = rows.groupBy(pid, *keys).agg(*[F.max(f"_pm_c_{o}").alias(f"_pm_m_{o}") for o in specs])
    ends = per_key.groupBy(pid).agg(F.min(key).alias("_pm_first"), F.max(key).alias("_pm_end"),
                                    *[F.max_by(F.struct(f"_pm_m_{o}"), key).alias(f"_pm_m_{o}") for o in specs])
    # one row per partition
    reach = Window.partitionBy("_pm_end").orderBy(pid)
    before = Window.orderBy(pid)
    ends = ends.select(pid, "_pm_first", "_pm_end", *[
        F.max(F.col(f"_pm_m_{o}")[f"_pm_m_{o}"]).over(reach).alias(f"_pm_r_{o}") for o in specs])
    carry = ends.select(pid, "_pm_first", F.lag("_pm_end").over(before).alias("_pm_left"), *[
        F.lag(f"_pm_r_{o}").over(before).alias(f"_pm_k_{o}") for o in specs])
    carry = carry.filter(F.col("_pm_left") == F.col("_pm_first")).select(
        F.col(pid).alias("_pm_at"), "_pm_first", *[f"_pm_k_{o}" for o in specs])
    w = Window.partitionBy(*keys, pid).orderBy(order)
    for out, inclusive in specs.items():
        frame = w.rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        rows = rows.withColumn(f"_pm_l_{out}", F.max(f"_pm_c_{out}").over(frame))
    res = rows.join(F.broadcast(carry), (F.col(pid) == F.col("_pm_at")) & (key.eqNullSafe(F.col("_pm_first"))), "left")
    for out in specs:
        res = res.withColumn(out, F.coalesce(F.col(f"_pm_l_{out}"), F.col(f"_pm_k_{out}")))
    return res.select(*df.columns, *specs)


def rank_within(df: DataFrame, keys, order: str, out: str = "ord", size_out: str | None = None) -> DataFrame:
    """0-based position of each row inside its key by ``order``; optionally the key's row
    count as ``size_out``. Every row keeps a position of its own, also rows of equal order
    (in no particular order) and rows with NULL keys or orders. Same plan as ``prev_match``,
    with the counts of a key's pieces as carry."""
    keys = _cols(keys)
    pid = "_rk_pid"
    rows = _ranged(df, [*keys, order], "rank", pid)
    counts = rows.groupBy(pid, *keys).agg(F.count(F.lit(1)).alias("_rk_n"))
    by_key = Window.partitionBy(*keys)
    # one row per key and partition: far fewer than rows wherever a key is large
    offs = counts.select(
        F.col(pid).alias("_rk_at"), F.struct(*keys).alias("_rk_key"),
        F.coalesce(F.sum("_rk_n").over(by_key.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_rk_off"),
        F.sum("_rk_n").over(by_key).alias("_rk_size"))
    local = rows.withColumn("_rk_rn", F.row_number().over(Window.partitionBy(*keys, pid).orderBy(order)) - 1)
    res = local.join(offs, (F.col(pid) == F.col("_rk_at")) & F.struct(*keys).eqNullSafe(F.col("_rk_key")))
    res = res.withColumn(out, (F.col("_rk_off") + F.col("_rk_rn")).cast("long"))
    if size_out:
        res = res.withColumn(size_out, F.col("_rk_size").cast("long"))
    return res.select(*df.columns, out, *([size_out] if size_out else []))


def global_index(df: DataFrame, order_cols: Sequence[str], out: str = "idx") -> DataFrame:
    """0-based consecutive index of every row in the order of ``order_cols`` (NULLs first).
    Rows may tie: each gets an index of its own, so the output has exactly the input's rows;
    add a column to ``order_cols`` to settle ties.

    A range-partitioned sort puts consecutive ranges in consecutive partitions; the sorted
    rows are written once, with an id that holds the partition number in its upper bits and
    the position inside the partition in the lower ones. The offsets have one row per
    partition, which bounds their broadcast. No row is joined back to itself.
    """
    s = materialize(df.orderBy(*order_cols).withColumn("_gi_mid", F.monotonically_increasing_id()), "index")
    pid = F.shiftrightunsigned(F.col("_gi_mid"), 33)
    counts = s.groupBy(pid.alias("_gi_pid")).agg(F.count(F.lit(1)).alias("_gi_n"))
    offs = counts.select(
        "_gi_pid",
        F.coalesce(F.sum("_gi_n").over(Window.orderBy("_gi_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_gi_off"))
    return (s.withColumn("_gi_pid", pid).join(F.broadcast(offs), "_gi_pid")
            .withColumn(out, (F.col("_gi_off") + F.col("_gi_mid") - F.shiftleft(F.col("_gi_pid"), 33)).cast("long"))
            .select(*df.columns, out))
