"""Session replay: the stream equals a plain replay, whatever the cut into batches."""

import random
import tempfile

import pytest

from credline.streaming import session as S

ACTIONS = ["fill", "fill", "fill", "add", "delete", "copy", "skip", "next", "cont", "other"]


def _log(seed, n, guids=3):
    rnd = random.Random(seed)
    out = []
    for seq in range(n):
        action = rnd.choice(ACTIONS)
        name = {"fill": rnd.choice(["role", "fillers", "none"]), "delete": rnd.choice("ab ")}.get(action)
        value = {"fill": rnd.choice(["a", "b", " x \ny", "", None]), "skip": rnd.choice(["DUPLICATE", "no text", "", None])}.get(action)
        out.append((f"g{rnd.randrange(guids)}", seq, rnd.randrange(12), action, name, value))
    return out


def _replay(log):
    """The rules told plainly: everything an annotator's screen holds, one event after the other."""
    files, screens = {}, {}
    for guid, seq, frame, action, name, value in sorted(log, key=lambda e: e[1]):
        s = screens.setdefault(guid, {"role": "", "fillers": "", "pairs": {}, "start": None})
        value = value or ""
        if action == "fill" and name in ("role", "fillers"):
            s[name] = s[name] + " " + value if s[name] else value
        if action in ("add", "next", "cont") and (s["role"] or s["fillers"]):
            if s["fillers"]:
                s["pairs"].setdefault(s["role"], [])
                s["pairs"][s["role"]] = [*s["pairs"][s["role"]], *(v.strip() for v in s["fillers"].split("\n"))]
            else:
                s["pairs"][s["role"]] = []
            s["role"] = s["fillers"] = ""
        if action == "delete":
            s["pairs"].pop(name or "", None)
        if action == "copy":
            good = [f for (g, f), r in files.items() if g == guid and f < frame and r[2] is None]
            if good:
                s["pairs"].update(files[guid, max(good)][3])
        if action == "skip" and value:
            files[guid, frame] = (seq, None, value, {})
        if s["pairs"] and (action == "next" or action == "cont" and s["start"] is not None):
            files[guid, frame] = (seq, s["start"] if action == "cont" else None, None, s["pairs"])
            s["start"] = frame if action == "next" else s["start"]
            s["pairs"] = {}
    return files


def _found(records):
    rows = S.last_records(records).collect()
    return {(r.guid, r.frame_num): (r.seq, r.continued_from, r.skip_reason, {b.role: b.fillers for b in r.bindings}) for r in rows}


def _stream(spark, drops):
    base = tempfile.mkdtemp(prefix="credline-session-")
    for i, drop in enumerate(drops):
        spark.createDataFrame(drop, S.LOG).repartition(3).write.parquet(f"{base}/src/drop{i}")
        stream = spark.readStream.schema(S.LOG).option("recursiveFileLookup", "true").parquet(f"{base}/src")
        (S.replay_sessions(stream).writeStream.outputMode("update").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
         .foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{base}/out")).start().awaitTermination())
    return spark.read.parquet(f"{base}/out")


def test_stream_in_pieces_equals_a_plain_replay(spark):
    log = _log(5, 700)
    again = [e for e in log[:300] if e[1] % 4 == 0]
    out = _stream(spark, [log[:150], log[150:300], log[300:] + again + again[:9]])
    want = _replay(log)
    assert _found(out) == want and len(want) > 20
    assert any(r[1] is not None for r in want.values()) and any(r[2] for r in want.values())
    counted = {r.guid: r.n_ignored for r in S.ignored_events(out).collect()}
    assert sum(counted.values()) == len(again) + 9


@pytest.mark.parametrize("seed", [1, 2])
def test_table_equals_a_plain_replay(spark, seed):
    log = _log(seed, 400)
    rows = [*log, (None, 1, 1, "next", None, None), ("g0", None, 1, "skip", None, "x"), ("g0", 9, None, "skip", None, "x")]
    df = spark.createDataFrame(rows, S.LOG)
    assert _found(S.replay_sessions(df)) == _replay(log)
    assert S.strays(df).count() == 3


def test_empty_log(spark):
    assert S.replay_sessions(spark.createDataFrame([], S.LOG)).count() == 0
