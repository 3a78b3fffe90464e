"""Streaming folds with bounded state: equal to a replay of what came in time, linear in writes."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from credline.streaming import bounded as B
from credline.streaming.state import ADJ_CODES, REVIEW_CODES, fold_review_events
from tests.test_review import ACTIONS, _replay


def _bits(state):
    return tuple(bool(state & b) for b in (B.ADJUSTED, B.DELETED, B.ANNOTATED, B.ACCEPTED))


@pytest.mark.parametrize("seed", range(30))
def test_review_bits_fold_in_pieces(seed):
    """Folding a log in any pieces gives what the closed form gives for the whole log."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 6, rng.integers(0, 40))
    state = 0
    for part in np.split(codes, np.sort(rng.integers(0, len(codes) + 1, 3))):
        state = B.fold_review(state, part)
    assert _bits(state) == tuple(map(bool, fold_review_events(np.arange(len(codes)), codes)))


class FakeState:
    """The handle's states in memory; counts the bytes that a map state writes."""

    def __init__(self):
        self.value, self.map, self.written, self.timers = None, {}, 0, set()

    def getValueState(self, *_):
        s = self
        return type("V", (), {"exists": lambda _: s.value is not None, "get": lambda _: s.value,
                              "update": lambda _, v: setattr(s, "value", v)})()

    def getMapState(self, *_):
        s = self

        def update(_, k, v):
            s.map[k] = v
            s.written += len(v[0])
        return type("M", (), {"keys": lambda _: list(s.map), "getValue": lambda _, k: s.map[k], "updateValue": update,
                              "containsKey": lambda _, k: k in s.map, "removeKey": lambda _, k: s.map.pop(k)})()

    def registerTimer(self, at):
        self.timers.add(at)


class Mark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_a_long_log_writes_state_in_proportion():
    """A row with a million events in 100 batches, a twentieth of them one batch late: the state
    stays small and the bytes written are a small multiple of the events."""
    import pandas as pd

    rng = np.random.default_rng(1)
    n, size = 100, 10_000
    actions = np.array(ACTIONS)[rng.integers(0, 5, n * size)]
    batch = np.arange(n * size) // size + (rng.random(n * size) < 0.05)
    fold, state = B.BoundedReview(2 * size * 1000 // B.BUCKETS), FakeState()
    fold.init(state)
    top = 0
    for i in range(n + 1):
        seq = np.flatnonzero(batch == i)
        rng.shuffle(seq)
        pdf = pd.DataFrame({"seq": seq, "action": actions[seq], "payload": None, "at_ms": seq * 1000})
        out = list(fold.handleInputRows((7,), iter([pdf]), Mark((i - 2) * size * 1000 if i > 1 else 0)))[0]
        top = max(top, sum(len(v[0]) for v in state.map.values()))
    want = _replay([(7, s, a) for s, a in enumerate(actions)])[7]
    assert tuple(out[c][0] for c in ("label_adjusted", "deleted", "annotated", "ocr_accepted")) == want
    assert out["n_late"][0] == 0
    assert top <= 8 * 4 * size and state.written < 4 * 8 * n * size


def _drops(events, n, seed):
    """Events in rough order over n drops: some a drop late, some repeated, some far too late."""
    rnd = random.Random(seed)
    out = [[] for _ in range(n)]
    for i, e in enumerate(events):
        d = i * n // len(events)
        d = n - 1 if rnd.random() < 0.02 else min(n - 1, d + (rnd.random() < 0.2))
        out[d].append(e)
        if rnd.random() < 0.1:
            out[min(n - 1, d + 1)].append(e)
    for drop in out:
        rnd.shuffle(drop)
    return out


def _in_time(drops, lateness):
    mark, kept, late = None, [], []
    for drop in drops:
        for e in drop:
            (late if mark is not None and mark > 0 and e[1] <= mark else kept).append(e)
        mark = max([mark or 0, *(e[1] - lateness for e in drop)])
    return kept, late


def _run(spark, drops, schema, fold, lateness):
    base = tempfile.mkdtemp(prefix="credline-bounded-")
    for i, drop in enumerate(drops):
        spark.createDataFrame(drop, schema).write.parquet(f"{base}/src/drop{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/src")
        (fold(stream, lateness).writeStream.outputMode("update").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
         .foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{base}/out")).start().awaitTermination())
    out = spark.read.parquet(f"{base}/out")
    late = sorted((r.row_id, r.seq, r.action) for r in B.late_events(out).collect())
    last = {}
    for r in sorted(out.collect(), key=lambda r: r.batch):
        last[r.row_id] = r
    return last, late


def test_review_stream_folds_what_came_in_time(spark):
    events = [(r, s, a, None) for r, s, a in [(random.Random(s).randrange(6), s, random.Random(-s).choice(ACTIONS)) for s in range(900)]]
    drops = _drops(events, 5, 3)
    kept, late = _in_time(drops, 300)
    assert late and len(kept) > 800
    got, side = _run(spark, drops, "row_id long, seq long, action string, payload string", B.review_state_bounded, 300)
    want = _replay([e[:3] for e in set(kept)])
    assert {k: (r.label_adjusted, r.deleted, r.annotated, r.ocr_accepted) for k, r in got.items()} == want
    assert side == sorted(e[:3] for e in late)
    assert sum(r.n_late for r in got.values()) == len(late)


def test_adjudication_stream_keeps_the_last_edit(spark):
    rnd = random.Random(9)
    actions = [*ADJ_CODES, "other"]
    events = [(rnd.randrange(5), s, a := rnd.choice(actions), f"t{s}" if a == "edit" and s % 3 else None) for s in range(600)]
    drops = _drops(events, 4, 5)
    kept, late = _in_time(drops, 250)
    got, side = _run(spark, drops, "row_id long, seq long, action string, payload string", B.adjudication_state_bounded, 250)
    for k, r in got.items():
        own = sorted({e for e in kept if e[0] == k}, key=lambda e: e[1])
        last = [e[2] for e in own if e[2] in ADJ_CODES][-1]
        edits = [e for e in own if e[2] == "edit"]
        assert (r.adjudicated, r.accepted, r.n_edits) == (last in ("accept", "reject"), last == "accept", len(edits))
        assert r.edited == [e[3] for e in edits if e[3]][-1]
    assert len(side) == len(late)


def test_codes_of_both_logs_fit_their_packing():
    assert max([*REVIEW_CODES.values(), *ADJ_CODES.values()]) < 8


class CountingState(FakeState):
    """Counts the calls that reach the state store."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def _counted(self, state):
        def call(name):
            def counted(*args):
                self.calls += 1
                return getattr(state, name)(*args)
            return counted
        return type("Counted", (), {"__getattr__": lambda _, name: call(name)})()

    def getValueState(self, *args):
        return self._counted(super().getValueState(*args))

    def getMapState(self, *args):
        return self._counted(super().getMapState(*args))

    def registerTimer(self, at):
        self.calls += 1
        super().registerTimer(at)


def _take(fold, events, mark):
    """A batch of (seq, action, payload) as rows, as ``transformWithState`` hands them over."""
    rows = [Row(row_id=7, seq=s, action=a, payload=p, at_ms=s * 1000) for s, a, p in events]
    (out,) = B.ByRow(fold).handleInputRows((7,), iter(rows), Mark(mark))
    return out


def test_a_short_row_costs_a_few_state_calls_a_batch():
    """Twenty events far apart lie in one value: no call for each bucket of event time."""
    fold, state = B.BoundedReview(1000 * 1000), CountingState()
    fold.init(state)
    for i in range(10):
        _take(fold, [(i * 4_000 + j * 700, ACTIONS[j % 5], None) for j in range(20)], max(0, (i - 4) * 4_000_000))
    assert state.calls <= 4 * 10 and not state.map


@pytest.mark.parametrize("seed", range(20))
def test_rows_settle_alike_in_one_value_and_in_buckets(seed):
    """Batches below and above ``FEW`` events, by turns: the row grows into buckets and comes back."""
    rnd = random.Random(seed)
    fold, state, seq, log, mark = B.BoundedAdjudication(40_000), FakeState(), 0, [], 0
    fold.init(state)
    held, spread = [], []
    for i in range(30):
        n = rnd.choice([1, 5, 30, B.FEW, 3 * B.FEW]) if 3 <= i < 20 else 30
        new = [(s, a := rnd.choice([*ADJ_CODES, "other"]), f"t{s}" if a == "edit" and s % 3 else None) for s in range(seq, seq + n)]
        late = [e for e in held if e[0] * 1000 <= mark]
        batch, held = new[: n - n // 8] + held + new[: n // 10], new[n - n // 8:]
        seq += n
        rnd.shuffle(batch)
        log += [e for e in batch if e not in late]
        out = _take(fold, batch, mark)
        assert [(x["seq"], x["action"]) for x in out.late] == [e[:2] for e in batch if e in late]
        own = sorted(set(log), key=lambda e: e[0])
        last = [e[1] for e in own if e[1] in ADJ_CODES][-1:]
        texts = [e[2] for e in own if e[2]][-1:] or [None]
        assert (out.adjudicated, out.accepted, out.n_edits, out.edited) == (
            last in (["accept"], ["reject"]), last == ["accept"], sum(e[1] == "edit" for e in own), texts[0])
        spread.append(bool(state.map))
        mark = max(mark, (max(e[0] for e in batch) - 100) * 1000)
    assert not spread[0] and any(spread) and not spread[-1]


@pytest.mark.parametrize("n", [20, 2 * B.FEW])
def test_an_idle_row_settles_by_its_timers(n):
    fold, state = B.BoundedReview(50_000), FakeState()
    fold.init(state)
    events = [(s, ACTIONS[s * 7 % 5], None) for s in range(0, 10 * n, 10)]
    out = _take(fold, events, 0)
    while state.timers:
        at = min(state.timers)
        state.timers.remove(at)
        assert list(fold.handleExpiredTimer((7,), Mark(at), None)) == []
    assert not state.map and not state.value[4] and not state.value[5]
    again = _take(fold, [], at)
    at_once = B.BoundedReview(50_000)  # or by a batch that comes after them
    at_once.init(own := FakeState())
    _take(at_once, events, 0)
    after = _take(at_once, [], at)
    assert own.value[:6] == state.value[:6] and not own.map
    assert out[1:5] == again[1:5] == after[1:5] == _replay([(7, *e[:2]) for e in events])[7]


def test_frames_and_rows_give_the_same_updates(spark):
    events = [(s % 9 - 4, s, random.Random(s).choice(ACTIONS), None) for s in range(2400)]
    drops = _drops(events, 3, 8) + [[(None, 2400, "swap", None), (1, None, "swap", None), (1, 2401, None, None)]]
    schema = "row_id long, seq long, action string, payload string"
    rows, late = _run(spark, drops, schema, B.review_state_bounded, 600)
    frames, late_too = _run(spark, drops, schema, lambda e, s: B.review_state_bounded(e, s, frames=True), 600)
    assert late == late_too and rows == frames and len(rows) == 10
