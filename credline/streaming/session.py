"""Annotation sessions replayed as a stateful stream (``transformWithStateInPandas``).

A session log holds what an annotator did in one video, in order: (guid, seq, frame_num, action,
name, value). The actions:

* ``fill``: ``value`` is appended to the slot ``name`` (``role`` or ``fillers``) with a space;
* ``add``: the slots become a pair (fillers are split into lines and stripped; without fillers
  the role is reset to none; with both slots empty nothing happens) and are emptied;
* ``delete``: the role ``name`` goes;
* ``copy``: the roles of the nearest earlier frame of the video that was saved and is not skipped
  are written over the current ones;
* ``skip``: with a reason in ``value`` the frame's record says so; what was entered stays;
* ``next``: adds the slots, and with any role saves the frame and starts a chain there;
* ``cont``: the same, but the record continues the chain; without a chain nothing is saved.

A record replaces the one its frame had. What was entered is cleared by a save and otherwise stays,
as on the annotator's screen. Unknown actions do nothing; null names and values are empty.

State per video: the slots, the current roles and the chain in one value, one map entry per saved
frame, and the sorted numbers of the frames that can be copied from (8 bytes each). So a batch reads
and writes the frames that it touches, whatever the length of the log. Events are applied in the
order of ``seq``; one at or below the last applied ``seq`` of its video has been delivered before (or
came too late) and is counted, not applied. A batch of one video is sorted in its task, as a session
can only be replayed in order: bound it by the source (``maxFilesPerTrigger``) where a log is long.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from credline.session import ship_package
from credline.streaming.bounded import ROCKSDB

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # as in ``bounded``

LOG = "guid string, seq long, frame_num long, action string, name string, value string"
RECORDS = ("guid string, frame_num long, seq long, continued_from long, skip_reason string, "
           "bindings array<struct<role:string,fillers:array<string>>>, n_ignored long")


class SessionReplay(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "seq long, role string, fillers string, chain long, roles string, n_ignored long")
        self.saved = handle.getMapState("saved", "frame long", "roles string")
        self.frames = handle.getValueState("frames", "nums binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, role, fillers, chain, roles, ignored = self.now.get() if self.now.exists() else (None, "", "", None, "{}", 0)
        self.role, self.fillers, self.chain, self.roles = role, fillers, chain, json.loads(roles)
        self.nums = np.frombuffer(bytes(self.frames.get()[0]), np.int64).tolist() if self.frames.exists() else []
        before = list(self.nums)
        out = []
        batch = pd.concat(rows).sort_values(["seq", "frame_num", "action", "name", "value"])
        for own, frame, action, name, value in batch[["seq", "frame_num", "action", "name", "value"]].itertuples(index=False):
            if seq is not None and own <= seq:
                ignored += 1
                continue
            seq = int(own)
            record = self._apply(int(frame), action, name, value)
            if record:
                out.append((key[0], int(frame), seq, *record))
        self.now.update((seq, self.role, self.fillers, self.chain, json.dumps(self.roles), ignored))
        if self.nums != before:
            self.frames.update((np.array(self.nums, np.int64).tobytes(),))
        out.append((key[0], None, seq, None, None, [], ignored))  # the video's own row
        yield pd.DataFrame(out, columns=["guid", "frame_num", "seq", "continued_from", "skip_reason", "bindings", "n_ignored"]).astype(
            {"frame_num": "Int64", "continued_from": "Int64", "n_ignored": "Int64"})

    def close(self) -> None:
        pass

    def _apply(self, frame: int, action: str, name: str, value: str) -> tuple | None:
        """Carry out one action; what it saved: (continued_from, skip_reason, bindings, None)."""
        if action == "fill" and name in ("role", "fillers"):
            slot = getattr(self, name)
            setattr(self, name, f"{slot} {value}" if slot else value)
        elif action == "delete":
            self.roles.pop(name, None)
        elif action == "copy":
            at = bisect_left(self.nums, frame)
            if at:
                self.roles |= json.loads(self.saved.getValue((self.nums[at - 1],))[0])
        elif action == "skip" and value:
            self._forget(frame)
            return None, value, [], None
        elif action in ("add", "next", "cont"):
            self._add()
            if action != "add" and self.roles and (action == "next" or self.chain is not None):
                return self._save(frame, action == "cont")
        return None

    def _add(self) -> None:
        if self.fillers:
            self.roles[self.role] = self.roles.get(self.role, []) + [x.strip() for x in self.fillers.split("\n")]
        elif self.role:
            self.roles[self.role] = []
        self.role = self.fillers = ""

    def _save(self, frame: int, continuing: bool) -> tuple:
        bindings = [{"role": k, "fillers": v} for k, v in sorted(self.roles.items())]
        if not continuing:
            self.chain = frame
        self._forget(frame)
        insort(self.nums, frame)
        self.saved.updateValue((frame,), (json.dumps(self.roles),))
        self.roles = {}
        return (self.chain if continuing else None), None, bindings, None

    def _forget(self, frame: int) -> None:
        at = bisect_left(self.nums, frame)
        if at < len(self.nums) and self.nums[at] == frame:
            del self.nums[at]
            self.saved.removeKey((frame,))


def replay_sessions(log: DataFrame) -> DataFrame:
    """Records from a session log (``LOG``), a stream or a table: one row per save or skip, and per
    batch and video one row without ``frame_num`` that holds the last ``seq`` and ``n_ignored``.
    Rows without guid, seq or frame belong to no session and are left out (``strays`` lists them)."""
    spark = log.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = log.filter(_whole()).select("guid", "seq", "frame_num", *map(text, ("action", "name", "value")))
    return rows.groupBy("guid").transformWithStateInPandas(SessionReplay(), RECORDS, outputMode="Update", timeMode="None")


def strays(log: DataFrame) -> DataFrame:
    return log.filter(~_whole())


def _whole():
    return F.col("guid").isNotNull() & F.col("seq").isNotNull() & F.col("frame_num").isNotNull()


def last_records(records: DataFrame) -> DataFrame:
    """The record of each frame: the last save or skip."""
    own = F.struct("continued_from", "skip_reason", "bindings")
    return (records.filter(F.col("frame_num").isNotNull()).groupBy("guid", "frame_num")
            .agg(F.max("seq").alias("seq"), F.max_by(own, "seq").alias("r")).select("guid", "frame_num", "seq", "r.*"))


def ignored_events(records: DataFrame) -> DataFrame:
    """guid, n_ignored: the events of each video that were not applied."""
    return records.filter(F.col("frame_num").isNull()).groupBy("guid").agg(F.max("n_ignored").alias("n_ignored"))
