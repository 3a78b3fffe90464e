"""Frames: names, time offsets, sampling, indexes, as-of copies, chains, pair folds."""

import datetime
import random

from pyspark.sql import functions as F

from credline.operators import common, frames
from tests.conftest import uncoalesced


def test_names_and_padding(spark):
    df = spark.createDataFrame([("cpb-aacip-1-x", 7), ("cpb-aacip-1-x", 12345)], "guid string, frame_num long")
    got = df.select(frames.frame_file_name("guid", "frame_num").alias("a"),
                    frames.padded_frame_name("guid", "frame_num").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("cpb-aacip-1-x.7.png", "cpb-aacip-1-x.0007.png"),
                                         ("cpb-aacip-1-x.12345.png", "cpb-aacip-1-x.12345.png")]
    g, n = frames.parse_frame_name(F.lit("cpb-aacip-1-x.0042.png"))
    r = spark.range(1).select(g.alias("g"), n.alias("n")).first()
    assert (r.g, r.n) == ("cpb-aacip-1-x", 42)


def test_frame_hms_like_timedelta(spark):
    nums = [0, 29, 30, 1799 * 30, 3600 * 30, 86399 * 30, 86400 * 30, 2 * 86400 * 30 + 95]
    df = spark.createDataFrame([(n,) for n in nums], "f long")
    got = [r[0] for r in df.select(frames.frame_hms("f")).collect()]
    assert got == [str(datetime.timedelta(seconds=n // 30)) for n in nums]


def test_sample_frames(spark):
    tf = spark.createDataFrame([("g", 0, 40), ("g", 30, 61), ("g", 5, 5), ("h", 10, 9)],
                               "guid string, start_frame long, end_frame long")
    got = sorted((r.guid, r.frame_num) for r in frames.sample_frames(tf).collect())
    exp = sorted({("g", f) for s, e in [(0, 40), (30, 61)] for f in range(s, e, 15)})
    assert got == exp


def _frames_df(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for g in ["a", "b", "c"]:
        for f in rnd.sample(range(0, 5000), n // 3):
            st = rnd.choice("FOP")
            rows.append((g, f, f"r{f}", st != "O", "DUPLICATE" if st == "P" else None))
    return rows, spark.createDataFrame(rows, "guid string, frame_num long, role string, annotated boolean, "
                                             "skip_reason string")


def test_copy_previous(spark):
    rows, df = _frames_df(spark)
    # 8 partitions for 3 guids: every guid is cut, so carries are exercised
    with uncoalesced(spark):
        out = common.prev_match(df, "guid", "frame_num", {
            "prev": (F.col("annotated") & F.col("skip_reason").isNull(), False)})
        got = {(r.guid, r.frame_num): r.prev for r in out.collect()}
    for g, f, _, _, _ in rows:
        cands = [x[1] for x in rows if x[0] == g and x[1] < f and x[3] and x[4] is None]
        assert got[(g, f)] == (max(cands) if cands else None)
    cp = {(r.guid, r.frame_num): (r.is_first, r.prev_role) for r in frames.copy_previous(df).collect()}
    for g, f, _, _, _ in rows:
        first = not any(x[0] == g and x[1] < f for x in rows)
        assert cp[(g, f)][0] == first


def test_rank_within_and_global_index(spark):
    rows, df = _frames_df(spark, seed=2)
    with uncoalesced(spark):
        ranked = {(r.guid, r.frame_num): (r.ord, r.n) for r in
                  common.rank_within(df, "guid", "frame_num", "ord", "n").collect()}
    for g in "abc":
        fs = sorted(x[1] for x in rows if x[0] == g)
        for i, f in enumerate(fs):
            assert ranked[(g, f)] == (i, len(fs))
    idx = {(r.guid, r.frame_num): r.frame_idx for r in frames.index_frames(df.repartition(7)).collect()}
    order = sorted((x[0], x[1]) for x in rows)
    assert [idx[k] for k in order] == list(range(len(order)))


def test_chains(spark):
    rows = [("g", 1, False), ("g", 2, True), ("g", 3, True), ("g", 4, False), ("g", 5, True), ("h", 1, True)]
    df = spark.createDataFrame(rows, "guid string, frame_num long, continuing boolean")
    got = {(r.guid, r.frame_num): r.continued_from for r in frames.chains(df).collect()}
    assert got == {("g", 1): None, ("g", 2): 1, ("g", 3): 1, ("g", 4): None, ("g", 5): 4, ("h", 1): None}


PAIRS = [  # guid, frame, seq, action, role, fillers
    ("g", 1, 1, "add", "Cast", "Ann\n Bo "), ("g", 1, 2, "add", "Cast", "Cy"),      # appended, split and stripped
    ("g", 1, 3, "add", "Props", "saw"), ("g", 1, 4, "add", "Props", ""),            # reset to no fillers
    ("g", 1, 5, "add", "", ""),                                                     # does nothing
    ("g", 1, 6, "add", "", "lone"),                                                 # the empty role is a role
    ("g", 1, 7, "add", "Gone", "x"), ("g", 1, 8, "delete", "Gone", None),
    ("g", 1, 9, "add", "Back", "x"), ("g", 1, 10, "delete", "Back", None), ("g", 1, 11, "add", "Back", "y\n"),
    ("g", 2, 1, "add", "Cast", "Di"), ("g", 2, 2, "add", "Cast", ""), ("g", 2, 3, "add", "Cast", "Ed"),
    ("h", 1, 1, "delete", "Cast", None),
]
PAIRS_WANT = {("g", 1): {"Cast": ["Ann", "Bo", "Cy"], "Props": [], "": ["lone"], "Back": ["y", ""]}, ("g", 2): {"Cast": ["Ed"]}}


def test_fold_pairs(spark):
    df = spark.createDataFrame(PAIRS, "guid string, frame long, seq long, action string, role string, fillers string")
    got = {}
    for r in sorted(frames.fold_pairs(df, ["guid", "frame"]).collect(), key=lambda r: (r.guid, r.frame, r.role, r.seq or -1, r.piece or -1)):
        d = got.setdefault((r.guid, r.frame), {}).setdefault(r.role, [])
        if r.filler is not None:
            d.append(r.filler)
    assert got == PAIRS_WANT


def test_repeated_and_malformed_frames_keep_their_rows(spark):
    rows = [("g", 15, "g.15.png"), ("g", 15, "g.0015.png"), ("g", None, "g.x.png"), ("g", 16, "g.16.png"), (None, None, "odd")]
    df = spark.createDataFrame(rows, "guid string, frame_num long, name string")
    got = {r.name: r.frame_idx for r in frames.index_frames(df, ["name"]).collect()}
    assert got == {"g.0015.png": 0, "g.15.png": 1, "g.16.png": 2}
    assert sorted(r.name for r in frames.malformed_frames(df).collect()) == ["g.x.png", "odd"]
    assert sorted(r.idx for r in common.global_index(df, ["guid", "frame_num"]).collect()) == [0, 1, 2, 3, 4]
    ranks = {r.name: (r.ord, r.n) for r in common.rank_within(df, "guid", "frame_num", "ord", "n").collect()}
    assert ranks["odd"] == (0, 1) and ranks["g.x.png"] == (0, 4) and ranks["g.16.png"] == (3, 4)
    assert {ranks["g.15.png"][0], ranks["g.0015.png"][0]} == {1, 2}
    prev = {r.name: r.p for r in common.prev_match(df, "guid", "frame_num", {"p": (F.lit(True), False)}).collect()}
    assert prev["g.15.png"] is None and prev["g.0015.png"] is None and prev["g.16.png"] == 15 and len(prev) == 5


def test_null_guid_carries_within_itself(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("g", 3, "c")], "guid string, frame_num long, role string")
    got = {r.frame_num: r.p for r in common.prev_match(df, "guid", "frame_num", {"p": (F.lit(True), False)}).collect()}
    assert got == {1: None, 2: 1, 3: None}


def test_duplicates_look_past_every_skipped_frame(spark):
    rows = [("g", 1, "r1", True, None), ("g", 2, "r2", True, "no text in image"), ("g", 3, "r3", True, "DUPLICATE"), ("g", 4, "r4", False, None),
            ("g", 5, "r5", True, "DUPLICATE")]
    df = spark.createDataFrame(rows, "guid string, frame_num long, role string, annotated boolean, skip_reason string")
    assert {(r.frame_num, r.source_frame, r.source_role) for r in frames.resolve_duplicates(df).collect()} == {(3, 1, "r1"), (5, 1, "r1")}


def test_overlay_of_copied_bindings(spark):
    rows = [("g", 1, {"Cast": ["a"], "Crew": ["b"], "_image_id": ["g.1"]}, True, None), ("g", 2, {"Cast": ["z"], "Props": []}, True, "no text in image"),
            ("g", 3, {"Cast": ["c"], "Host": ["d"]}, False, None), ("h", 9, None, False, None)]
    df = spark.createDataFrame(rows, "guid string, frame_num long, bindings map<string,array<string>>, annotated boolean, skip_reason string")
    got = {r.frame_num: (r.prev_frame, dict(r.copied)) for r in frames.copy_previous_bindings(df).collect()}
    assert got[3] == (1, {"Cast": ["a"], "Crew": ["b"], "Host": ["d"]})
    assert got[2] == (1, {"Cast": ["a"], "Crew": ["b"], "Props": []})
    assert got[9] == (None, {}) and got[1][0] is None


def test_chain_bindings(spark):
    rows = [("g", 1, False, "r1", "a"), ("g", 2, True, "r2", "b"), ("g", 3, False, "r3", "c"), ("h", 5, True, "r4", "d")]
    df = spark.createDataFrame(rows, "guid string, frame_num long, continuing boolean, role string, filler string")
    got = sorted((r.guid, r.chain_start, r.place, r.role) for r in frames.chain_bindings(frames.chains(df)).collect())
    assert got == [("g", 1, 0, "r1"), ("g", 1, 1, "r2"), ("g", 3, 0, "r3")]


def test_progress_counts_independently(spark):
    fr = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "guid string, frame_num long")
    an = spark.createDataFrame([("a", 1), ("c", 9)], "guid string, frame_num long")
    got = {r.guid: r.progress for r in frames.progress(fr, an).collect()}
    assert got == {"a": "1/2", "b": "0/1", "c": "1/0"}
