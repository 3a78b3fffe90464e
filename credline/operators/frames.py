"""Frames of a video: names, sampling, indexes, progress, as-of copies, chains, pair logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credline.functions.text import append_joined, split_lines_stripped
from credline.operators.common import global_index, prev_match, rank_within
from credline.schemas import (CATALOG_PREFIX, FRAME_STRIDE, FRAMES_PER_SECOND, GUID_PREFIX,
                              REASON_DUPLICATE)


SALT = 16


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- names
def image_id(guid, frame) -> Column:
    """``<guid>.<frame>`` with the frame number unpadded."""
    return F.concat_ws(".", _c(guid), _c(frame).cast("string"))


def frame_file_name(guid, frame) -> Column:
    return F.concat(image_id(guid, frame), F.lit(".png"))


def padded_frame_name(guid, frame) -> Column:
    """``<guid>.<frame, zero-padded to 4 digits>.png``; longer numbers are kept whole."""
    return F.format_string("%s.%04d.png", _c(guid), _c(frame))


def parse_frame_name(name) -> tuple[Column, Column]:
    """File name -> (guid, frame_num) from the first two dot-separated fields."""
    parts = F.split(_c(name), r"\.")
    return parts[0], F.try_element_at(parts, F.lit(2)).try_cast("bigint")


def frame_hms(frame) -> Column:
    """Offset of a frame at the assumed frame rate, written like Python's timedelta:
    ``H:MM:SS``, or ``N day(s), H:MM:SS`` from one day on."""
    secs = F.floor(_c(frame) / F.lit(FRAMES_PER_SECOND)).cast("long")
    days = F.floor(secs / F.lit(86400)).cast("long")
    rem = secs - days * 86400
    hms = F.format_string("%d:%02d:%02d", F.floor(rem / 3600).cast("long"),
                          F.floor((rem % 3600) / 60).cast("long"), (rem % 60).cast("long"))
    return F.when(days == 0, hms).otherwise(F.format_string(
        "%d %s, %s", days, F.when(days == 1, F.lit("day")).otherwise(F.lit("days")), hms))


def catalog_key(guid) -> Column:
    return F.replace(_c(guid), F.lit(GUID_PREFIX), F.lit(CATALOG_PREFIX))


# --------------------------------------------------------------------------- sampling
def sample_frames(timeframes: DataFrame, guid: str = "guid", start: str = "start_frame",
                  end: str = "end_frame", stride: int = FRAME_STRIDE,
                  include_end: bool = False) -> DataFrame:
    """Every ``stride``-th frame of each time frame, overlapping samples collapsed to one."""
    stop = F.col(end) if include_end else F.col(end) - 1
    seq = F.when(stop >= F.col(start), F.sequence(F.col(start), stop, F.lit(stride).cast("long")))
    return (timeframes.select(guid, F.explode(seq).alias("frame_num"))
            .dropDuplicates([guid, "frame_num"]))


# --------------------------------------------------------------------------- indexes
def index_frames(frames: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Global 0-based index over (guid, frame_num, *ties). Files of one frame (padded and
    unpadded names) each keep a place, settled by ``ties`` (say, the file name); rows without
    a frame number are left out: see ``malformed_frames``."""
    return global_index(frames.filter(F.col("frame_num").isNotNull() & F.col("guid").isNotNull()),
                        ["guid", "frame_num", *ties], "frame_idx")


def malformed_frames(frames: DataFrame) -> DataFrame:
    """The quarantine of ``index_frames``: rows whose name gave no guid or frame number."""
    return frames.filter(F.col("frame_num").isNull() | F.col("guid").isNull())


def frames_in_guid(frames: DataFrame) -> DataFrame:
    """Each frame's 0-based place in its guid and the guid's frame count (long form of
    the sorted frame list; no list is collected)."""
    return rank_within(frames, "guid", "frame_num", "frame_ord", size_out="n_frames")


def lookup_rows(indexed: DataFrame, requests: DataFrame, idx: str = "req_idx") -> DataFrame:
    """Point lookups by global index; out-of-range requests return nothing."""
    return requests.join(indexed, requests[idx] == indexed["frame_idx"], "inner")


# --------------------------------------------------------------------------- progress
def progress(frames: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per guid: annotation records and frames, counted independently (as two file globs
    would), plus ``done/total``."""
    t = frames.groupBy("guid").agg(F.count(F.lit(1)).alias("n_total"))
    d = annotations.groupBy("guid").agg(F.count(F.lit(1)).alias("n_done"))
    out = t.join(d, "guid", "full_outer").select(
        "guid", F.coalesce("n_done", F.lit(0)).cast("long").alias("n_done"),
        F.coalesce("n_total", F.lit(0)).cast("long").alias("n_total"))
    return out.withColumn("progress", F.concat_ws("/", F.col("n_done").cast("string"),
                                                  F.col("n_total").cast("string")))


def done_frames(frames: DataFrame, annotations: DataFrame) -> DataFrame:
    return frames.join(annotations.select("guid", "frame_num"), ["guid", "frame_num"], "left_semi")


def todo_frames(frames: DataFrame, annotations: DataFrame) -> DataFrame:
    return frames.join(annotations.select("guid", "frame_num"), ["guid", "frame_num"], "left_anti")


def next_todo(frames: DataFrame, done: str = "annotated") -> DataFrame:
    """Per guid: the first frame without annotation, else the last frame."""
    d = F.col(done)
    return frames.groupBy("guid").agg(
        F.min(F.when(~d, F.col("frame_num"))).alias("_first_todo"),
        F.max("frame_num").alias("_last"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(~d).alias("n_todo"),
    ).select("guid", F.coalesce("_first_todo", "_last").alias("next_frame"),
             F.col("n_total").cast("long"), F.col("n_todo").cast("long"),
             F.col("_first_todo").isNull().alias("all_done"))


# --------------------------------------------------------------------------- as-of copies
def _usable() -> Column:
    """A frame that annotations are copied from: annotated, and not skipped for any reason."""
    return F.col("annotated") & F.col("skip_reason").isNull()


def copy_previous(frames: DataFrame, payload: str = "role") -> DataFrame:
    """For each frame: whether it is the first of its guid, the nearest earlier frame of
    the same guid that holds an annotation and was not skipped, and that frame's payload
    (the annotations a copy would take over). The payload travels with the as-of match,
    so no join back to the matched frame is needed (a run of frames that all copy from
    the same frame would make that join key hot)."""
    out = prev_match(frames, "guid", "frame_num", {
        "_any_prev": (F.lit(True), False),
        "_prev": (_usable(), False, [payload]),
    })
    return (out.withColumn("prev_frame", F.col("_prev.frame_num"))
            .withColumn(f"prev_{payload}", F.col(f"_prev.{payload}"))
            .withColumn("is_first", F.col("_any_prev").isNull()).drop("_any_prev", "_prev"))


def overlay(current: Column, copied: Column) -> Column:
    """Roles of ``copied`` (keys that start with ``_`` are no roles) written over the map
    ``current``; NULL maps are empty."""
    kind = "map<string,array<string>>"
    now = F.coalesce(current, F.create_map().cast(kind))
    new = F.map_filter(F.coalesce(copied, F.create_map().cast(kind)), lambda k, v: ~k.startswith("_"))
    return F.map_concat(F.map_filter(now, lambda k, v: ~F.map_contains_key(new, k)), new)


def copy_previous_bindings(frames: DataFrame, bindings: str = "bindings") -> DataFrame:
    """``copy_previous`` for a map of roles to fillers: adds ``prev_frame``, ``is_first`` and
    ``copied``, the frame's own bindings under the roles of the frame copied from."""
    entries = frames.withColumn("_entries", F.map_entries(bindings))  # maps do not compare, arrays do
    out = copy_previous(entries, "_entries")
    return out.withColumn("copied", overlay(F.col(bindings), F.map_from_entries("prev__entries"))).drop("_entries", "prev__entries")


def resolve_duplicates(frames: DataFrame, payload: str = "role") -> DataFrame:
    """Frames skipped as duplicates inherit the annotation of the nearest earlier frame
    of the same guid that is annotated and was not skipped, for this or any other reason."""
    out = prev_match(frames, "guid", "frame_num", {"_src": (_usable(), False, [payload])})
    return (out.filter(F.col("skip_reason") == REASON_DUPLICATE)
            .withColumn("source_frame", F.col("_src.frame_num"))
            .withColumn(f"source_{payload}", F.col(f"_src.{payload}")).drop("_src"))


def chains(frames: DataFrame, continuing: str = "continuing") -> DataFrame:
    """Continuation chains: a normal save starts a chain, a continuing save appends to the
    chain of the latest normal save of the same guid (``continued_from``; NULL when there
    is none)."""
    out = prev_match(frames, "guid", "frame_num", {"chain_start": (~F.col(continuing), True)})
    return out.withColumn("continued_from", F.when(F.col(continuing), F.col("chain_start")))


def chain_bindings(chained: DataFrame, role: str = "role", filler: str = "filler") -> DataFrame:
    """The bindings of each chain one after the other, long form: guid, chain_start, place
    (0-based, in frame order), frame_num, role, filler. Continuing saves without a chain to
    continue are not part of any. No chain is collected."""
    rows = chained.filter(F.col("chain_start").isNotNull()).select("guid", "chain_start", "frame_num", role, filler)
    return rank_within(rows, ["guid", "chain_start"], "frame_num", "place")


# --------------------------------------------------------------------------- pair log
def fold_pairs(log: DataFrame, key: str | Sequence[str] = "guid") -> DataFrame:
    """Role -> fillers binding folded from an ``add``/``delete`` log (key, seq, action,
    role, fillers); the key holds the frame wherever a log is kept per frame.

    ``add`` with a non-empty fillers field appends its newline-split, stripped pieces;
    ``add`` with an empty field resets the role to no fillers; an empty role with an
    empty field does nothing; ``delete`` removes the role. Output, long form: key, role,
    seq, piece, filler (filler NULL for a role that exists without fillers).
    """
    keys = [key] if isinstance(key, str) else list(key)
    a = F.col("action")
    empty_f = F.coalesce(F.col("fillers"), F.lit("")) == ""
    noop = (a == "add") & (F.col("role") == "") & empty_f
    reset = (a == "delete") | ((a == "add") & empty_f)
    ev = log.filter(~noop).withColumn("_salt", F.pmod("seq", F.lit(SALT)).cast("int"))
    state = ev.groupBy(*keys, "role").agg(
        F.max(F.when(reset, F.col("seq"))).alias("_reset"),
        F.max(F.when(a == "delete", F.col("seq"))).alias("_del"),
        F.max(F.when(a == "add", F.col("seq"))).alias("_add"))
    alive = state.filter(F.col("_add").isNotNull() & (F.col("_del").isNull() | (F.col("_add") > F.col("_del"))))
    # a role's last reset meets its adds in a join salted by ``seq``
    adds = ev.filter((a == "add") & ~empty_f).select(*keys, "role", "seq", "_salt", "fillers")
    each = alive.select(*keys, "role", "_reset", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    kept = adds.join(each, [*keys, "role", "_salt"]).filter(
        F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).select(
        *keys, "role", "seq", F.posexplode(split_lines_stripped("fillers")).alias("piece", "filler"))
    # a living role has no fillers exactly if its last add is its reset
    none = lambda t: F.lit(None).cast(t)
    empty_roles = alive.filter(F.col("_reset") == F.col("_add")).select(
        *keys, "role", none("long").alias("seq"), none("long").alias("piece"), none("string").alias("filler"))
    return kept.withColumn("piece", F.col("piece").cast("long")).unionByName(empty_roles)


def last_write(log: DataFrame, key, order: str, value_cols) -> DataFrame:
    """Last write wins per key: the values of the row with the largest ``order``."""
    keys = [key] if isinstance(key, str) else list(key)
    best = F.max_by(F.struct(*[F.col(c) for c in value_cols]), F.col(order)).alias("_w")
    return log.groupBy(*keys).agg(best, F.max(order).alias(order)).select(
        *keys, order, *[F.col(f"_w.{c}").alias(c) for c in value_cols])


def autofill(clicks: DataFrame, keys, order: str, text: str = "text") -> DataFrame:
    """Append clicked texts to a slot with a space, in click order (``s = r`` while the
    slot is empty, else ``s += ' ' + r``). ``keys`` hold the frame: the clicks of one frame's
    slot are collected, which a frame's boxes bound."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))),
                         lambda x: x[text])
    return clicks.groupBy(*keys).agg(append_joined(pieces).alias("value"))
