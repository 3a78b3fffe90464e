import math
import random

import numpy as np
import pytest

from credline.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, shard int, score long, v string"


def brute(rows, k, every, scale):
    seen = {}
    vecs = []
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        vecs.append((i, [math.floor(scale * float(np.float32(x))) for x in e]))
    for q, a in vecs:
        if q % every:
            continue
        found = {(-sum(x * y for x, y in zip(a, b)), i) for i, b in vecs if i != q and len(a) == len(b)}
        seen[q] = [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(x for xs in seen.values() for x in xs)


def table(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) * rng.random() for _ in range(6)]) for i in range(n)]
    rows += [(i, [0.5] * 6) for i in range(n, n + 120)]  # one common vector
    rows += [(1000, None), (1001, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1020, [float("inf")] * 6),
             (None, [0.1] * 6), (1040, [1.0, 2.0]), (1041, [2.0, 1.0]), (1060, []), (1061, []), (-20, [-0.01] * 6)]
    return rows


@pytest.mark.parametrize("shard_rows", [40, 4096])
def test_against_brute_force(spark, shard_rows, monkeypatch):
    rows = table(shard_rows)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    got = K.top_k(df, k=7, shard_rows=shard_rows).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 7, K.EVERY, K.SCALE)


def test_search_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    vecs = rng.integers(-5, 6, (5000, 3))
    vecs[:1500] = [2, 2, 2]
    ids = rng.permutation(5000)
    tree = K.build_tree(ids, vecs)
    for kth in (None, (12, 100)):
        got = K.search(tree, ids[:20], vecs[:20], [kth] * 20, 9)
        want = []
        for q, v in zip(ids[:20].tolist(), vecs[:20]):
            s = sorted((-int(x), int(i)) for x, i in zip(vecs @ v, ids) if i != q)
            want += [(q, i, -x) for x, i in s[:9] if kth is None or (x, i) < (-kth[0], kth[1])]
        assert got == want


def test_large_numbers_stay_exact():
    vecs = np.array([[1 << 40, 3], [1 << 40, 4], [-(1 << 40), 9]])
    tree = K.build_tree(np.array([1, 2, 3]), vecs)
    assert K.search(tree, np.array([1]), vecs[:1], [None], 5) == [(1, 2, (1 << 80) + 12), (1, 3, -(1 << 80) + 27)]


def test_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])]
    got = K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in got] == [(20, 1, 1, 4096), (20, 2, 2, 2048)]


def test_empty_table(spark):
    assert K.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
