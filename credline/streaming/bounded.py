"""Decision folds over endless logs with bounded state (``transformWithState``).

A row's state has two parts. Events above the watermark are open: they wait in buckets of event
time, so that late ones can still take their place. Once the watermark has passed a bucket nothing
may join it, its events are folded into the settled part (a few numbers and the last edited text)
and the bucket goes. Up to ``FEW`` open events lie in the same value as the settled part, which a
batch reads and writes once; a row of more has a map state with one packed value per bucket until
few are left. So a row keeps what is younger than the allowed lateness, whatever the
length of its log, and a batch writes the buckets that its events fall into, not the log. Rows that
get no more events settle by event-time timers.

An event is as old as ``seq`` says (``at`` maps it to a time that rises with it). What comes at or
below the watermark is too late: it changes no decision, is counted per row (``n_late``) and listed
in the update (``late``), from which ``late_events`` makes a side table. A repeated delivery
counts once while its bucket is open, and as late afterwards.

Spark's own late filter would drop such rows unseen; the folds compare with the watermark
themselves, so the event time reaches them as a plain number. Stream-to-sink use::

    updates = review_state_bounded(events, "2 hours").writeStream.outputMode("update")
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from credline.session import ship_package
from credline.streaming.state import (ACCEPT, ADJ_CODES, DECLINE, DELETE, EDIT, REJECT, REVIEW_CODES, REVOKE, SUBMIT, SWAP,
                                      UNDO)

# Spark unpickles a processor in a helper process of the driver too, which knows no ``addPyFile``
# archives, so the classes of this module travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "n_late long, late array<struct<seq:long,action:string>>"
REVIEW_OUT = f"row_id long, label_adjusted boolean, deleted boolean, annotated boolean, ocr_accepted boolean, {LATE}"
ADJ_OUT = f"row_id long, adjudicated boolean, accepted boolean, n_edits long, edited string, {LATE}"
BUCKETS = 16  # buckets of event time within the allowed lateness
FEW = 256  # open events that a row keeps with its settled part (16 bytes each), without buckets of their own
CHUNK = 8192  # events of a row that are taken in at a time

# review decisions as bits of one number
ADJUSTED, DELETED, ANNOTATED, PENDING, ACCEPTED = 1, 2, 4, 8, 16


def fold_review(state: int, codes: np.ndarray) -> int:
    """The review bits after ordered events, starting from the bits before them."""
    odd = lambda code, part=slice(None): np.count_nonzero(codes[part] == code) % 2 == 1
    if odd(SWAP):
        state ^= ADJUSTED
    if odd(DELETE):
        state ^= DELETED
    commits = np.flatnonzero((codes == SUBMIT) | (codes == DELETE))
    undos = np.flatnonzero(codes == UNDO)
    pending = bool(state & PENDING)
    if len(commits):
        at = commits[-1]
        before = undos[undos < at]
        rejected = odd(REJECT, slice(before[-1] + 1, at)) if len(before) else pending ^ odd(REJECT, slice(0, at))
        state = state & ~ACCEPTED | (0 if rejected else ACCEPTED)
    if len(commits) or len(undos):
        last = max(commits[-1] if len(commits) else -1, undos[-1] if len(undos) else -1)
        state = state & ~ANNOTATED | (ANNOTATED if codes[last] != UNDO else 0)
    pending = odd(REJECT, slice(undos[-1] + 1, None)) if len(undos) else pending ^ odd(REJECT)
    return state & ~PENDING | (PENDING if pending else 0)


def fold_adjudication(state: int, codes: np.ndarray) -> int:
    """The last decision (upper bits: the number of edits) after ordered events."""
    known = codes[(codes >= ACCEPT) & (codes <= REVOKE)]
    last = int(known[-1]) if len(known) else state & 7
    return ((state >> 3) + int(np.count_nonzero(codes == EDIT))) << 3 | last


class BoundedFold(StatefulProcessor):
    """Keeps the settled part, the open events and the late count of each row."""

    def __init__(self, codes: dict[str, int], fold, width_ms: int):
        self.codes, self.fold, self.width = codes, fold, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "state long, edit_seq long, edited string, n_late long, few binary, spread boolean, timer long")
        self.open = handle.getMapState("open", "bucket long", "events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = self.taken(key, map(_columns, rows), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({k: pd.Series([v], dtype=object if k in ("edited", "late") else None) for k, v in out.items()})

    def taken(self, key, chunks: Iterator[tuple[np.ndarray, ...]], mark: int) -> dict:
        """Take the events of a batch in; the row's update."""
        before = self._read()
        state, edit_seq, edited, n_late, few, spread, timer = before
        few, late = _unpacked(few), []
        for seq, at, action, payload in chunks:
            if mark > 0 and (gone := at <= mark).any():
                late += [{"seq": s, "action": a} for s, a in zip(seq[gone].tolist(), action[gone])]
                seq, at, action, payload = (x[~gone] for x in (seq, at, action, payload))
            code = np.fromiter((self.codes.get(a, 0) for a in action), np.int64, len(action))
            texts = np.flatnonzero((code == self.codes.get("edit", -1)) & pd.notna(payload))
            if len(texts) and seq[last := texts[seq[texts].argmax()]] > edit_seq:
                edit_seq, edited = int(seq[last]), payload[last]
            known = code > 0
            few = _merged(few, at[known] // self.width, seq[known] * 8 + code[known])
            if spread or few.shape[1] > FEW:
                spread = True
                self._add(few)
                few = few[:, :0]
        settled, ahead = self._settle((state, edit_seq, edited, n_late + len(late), few.tobytes(), spread, timer), mark)
        if settled != before:
            self.settled.update(settled)
        now = settled[0]
        for events in ahead:
            now = self.fold(now, events % 8)
        return {"row_id": key[0], **self.row(now, settled[2]), "n_late": settled[3], "late": late}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._read()
        after, _ = self._settle(before, timerValues.getCurrentWatermarkInMs(), ahead=False)
        if after != before:
            self.settled.update(after)
        return iter(())

    def close(self) -> None:
        pass

    def _read(self) -> tuple:
        if not self.settled.exists():
            return 0, -1, None, 0, b"", False, None
        *rest, few, spread, timer = self.settled.get()
        return *rest, bytes(few), spread, timer

    def _add(self, few: np.ndarray) -> None:
        """The events' buckets, each written once."""
        for bucket in np.unique(few[0]).tolist():
            own = few[1][few[0] == bucket]
            if self.open.containsKey((bucket,)):
                events = bytes(self.open.getValue((bucket,))[0])
                merged = np.unique(np.concatenate((np.frombuffer(events, np.int64), own))).tobytes()
                if merged == events:
                    continue
            else:
                merged = own.tobytes()
            self.open.updateValue((bucket,), (merged,))

    def _settle(self, row: tuple, mark: int, ahead: bool = True) -> tuple[tuple, list[np.ndarray]]:
        """Fold the buckets that the watermark has passed and set a timer for the next one; the row
        then, and its events that stay open, in order (``ahead``: not needed otherwise)."""
        state, edit_seq, edited, n_late, few, spread, timer = row
        if spread:
            buckets, rest = sorted(k[0] for k in self.open.keys()), []
            while buckets and (buckets[0] + 1) * self.width - 1 <= mark:
                state = self.fold(state, self._bucket(buckets[0]) % 8)
                self.open.removeKey((buckets.pop(0),))
            if ahead:
                rest = [self._bucket(b) for b in buckets]
                if buckets and sum(map(len, rest)) <= FEW // 2:  # few again
                    few = np.stack((np.repeat(np.array(buckets, np.int64), [len(x) for x in rest]), np.concatenate((_unpacked(b"")[1], *rest)))).tobytes()
                    for b in buckets:
                        self.open.removeKey((b,))
            spread = bool(buckets) and not few
        else:
            own = _unpacked(few)
            done = (own[0] + 1) * self.width - 1 <= mark
            if done.any():
                state = self.fold(state, own[1][done] % 8)
                own = own[:, ~done]
            few, buckets, rest = own.tobytes(), own[0][:1].tolist(), [own[1]]
        if buckets:
            due = (buckets[0] + 1) * self.width
            if timer is None or timer <= mark or due < timer:  # else one is set that comes first
                self.handle.registerTimer(due)
                timer = due
        return (state, edit_seq, edited, n_late, few, spread, timer), rest

    def _bucket(self, bucket: int) -> np.ndarray:
        return np.frombuffer(bytes(self.open.getValue((bucket,))[0]), np.int64)


def _columns(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """seq, at_ms, action and payload of the events that have a place in the log."""
    if pdf["seq"].hasnans or pdf["at_ms"].hasnans:
        pdf = pdf.dropna(subset=["seq", "at_ms"])
    return (pdf["seq"].to_numpy(np.int64), pdf["at_ms"].to_numpy(np.int64), pdf["action"].to_numpy(object),
            pdf["payload"].to_numpy(object))


def _unpacked(few: bytes) -> np.ndarray:
    """The buckets (first row) and packed events (second) of a row of few open events, in order."""
    return np.frombuffer(few, np.int64).reshape(2, -1)


def _merged(few: np.ndarray, buckets: np.ndarray, events: np.ndarray) -> np.ndarray:
    """With further events; what is there already is not added. Buckets rise with the events."""
    events, first = np.unique(np.concatenate((few[1], events)), return_index=True)
    return np.stack((np.concatenate((few[0], buckets))[first], events))


class BoundedReview(BoundedFold):
    def __init__(self, width_ms: int):
        super().__init__(REVIEW_CODES, fold_review, width_ms)

    def row(self, state: int, edited: str | None) -> dict:
        return {"label_adjusted": bool(state & ADJUSTED), "deleted": bool(state & DELETED),
                "annotated": bool(state & ANNOTATED), "ocr_accepted": bool(state & ACCEPTED)}


class BoundedAdjudication(BoundedFold):
    def __init__(self, width_ms: int):
        super().__init__(ADJ_CODES, fold_adjudication, width_ms)

    def row(self, state: int, edited: str | None) -> dict:
        last = state & 7
        return {"adjudicated": last in (ACCEPT, DECLINE), "accepted": last == ACCEPT, "n_edits": state >> 3, "edited": edited}


class ByRow(StatefulProcessor):
    """A fold whose events and updates are rows, not frames: a frame for each key and batch takes
    longer than the fold of some dozens of events."""

    def __init__(self, fold: BoundedFold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold.init(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield Row(**self.fold.taken(key, _chunks(rows), timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.fold.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def close(self) -> None:
        self.fold.close()


def _chunks(rows: Iterator[Row]) -> Iterator[tuple[np.ndarray, ...]]:
    """``_columns`` of some thousand rows at a time."""
    while some := list(islice(rows, CHUNK)):
        _, seq, action, payload, at = zip(*some)
        if None in seq or None in at:
            if not (some := [r for r in some if r[1] is not None and r[4] is not None]):
                continue
            _, seq, action, payload, at = zip(*some)
        yield np.array(seq, np.int64), np.array(at, np.int64), np.array(action, object), np.array(payload, object)


def _bounded(events: DataFrame, processor, out: str, lateness_s: int, at: Column | None, frames: bool) -> DataFrame:
    spark = events.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the store that this operator needs
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a batch uploads its changes
    payload = F.col("payload") if "payload" in events.columns else F.lit(None).cast("string")
    rows = (events.withColumn("_at", F.timestamp_seconds("seq") if at is None else at).withWatermark("_at", f"{lateness_s} seconds")
            .select("row_id", "seq", "action", payload.alias("payload"), F.unix_millis("_at").alias("at_ms")))
    fold, by_id = processor(max(1, lateness_s * 1000 // BUCKETS)), rows.groupBy("row_id")
    if frames:
        return by_id.transformWithStateInPandas(fold, out, outputMode="Update", timeMode="EventTime")
    return by_id.transformWithState(ByRow(fold), out, outputMode="Update", timeMode="EventTime")


def review_state_bounded(events: DataFrame, lateness_s: int, at: Column | None = None, frames: bool = False) -> DataFrame:
    """Streaming review fold over (row_id, seq, action) with the allowed lateness in seconds of
    event time. Without ``at`` a ``seq`` counts as one second. ``frames``: the events of a row reach
    the fold as pandas frames, for logs that bring thousands of events of a row at a time."""
    return _bounded(events, BoundedReview, REVIEW_OUT, lateness_s, at, frames)


def adjudication_state_bounded(events: DataFrame, lateness_s: int, at: Column | None = None, frames: bool = False) -> DataFrame:
    """Streaming adjudication fold over (row_id, seq, action[, payload])."""
    return _bounded(events, BoundedAdjudication, ADJ_OUT, lateness_s, at, frames)


def late_events(updates: DataFrame) -> DataFrame:
    """The side table of a batch of updates: row_id, seq, action of every event that came too late."""
    return updates.select("row_id", F.inline("late"))
