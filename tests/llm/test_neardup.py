import random

import numpy as np
import pytest

from credline.llm import neardup as N
from tests.llm import brute


def groups(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 30, 80]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            ws = [word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(ws).upper() if rng.random() < 0.3 else " ".join(ws)))
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, t) for i, (_, t) in zip(order, rows)]


@pytest.mark.parametrize("bucket,group", [(2048, 2_000_000), (4, 200)])
def test_against_brute_force(spark, monkeypatch, bucket, group):
    monkeypatch.setattr(N, "BUCKET", bucket)
    monkeypatch.setattr(N, "GROUP", group)
    rows = groups(bucket) + [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "İ ſ K"), (10_004, "a b c d e"), (10_005, "A b c d E")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs).collect()}
    assert got == brute.near_dup(rows)


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(documents).collect()}
    assert got == brute.near_dup(rows)


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.75, 0.9):
        got = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            n = round(600 * 2 * share / (1 + share))
            y = np.concatenate((x[:n], rng.integers(0, 1 << 63, 600 - n, dtype=np.uint64)))
            _, sig = N.signatures([np.unique(x), np.unique(y)])
            got.append(float(N.agreement(sig[0], sig[1])))
        assert abs(np.mean(got) - share) < 0.03 and np.std(got) < 0.06


def test_exact_forest_connects_what_is_linked():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 62, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(base, 180, replace=False), rng.integers(0, 1 << 62, int(k), dtype=np.uint64))))
            for k in rng.integers(0, 60, 50)]
    linked = lambda a, b: 100 * (i := len(np.intersect1d(a, b))) >= 75 * (len(a) + len(b) - i)
    edges = list(N.exact_forest(sets, 75))
    assert all(linked(sets[a], sets[b]) for a, b in edges)

    def parts(pairs):
        of = list(range(len(sets)))
        for a, b in pairs:
            x, y = of[a], of[b]
            of = [x if z == y else z for z in of]
        return [of.index(x) for x in of]
    assert parts(edges) == parts((a, b) for a in range(50) for b in range(a) if linked(sets[a], sets[b]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (7, 7), (200, 201), (200, 201)]
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def test_messy_rows(messy, messy_rows):
    got = N.near_duplicates(messy).collect()
    assert len(got) == len(messy_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(1, 4, True)] and by[9] == [(1, 4, False)] * 2
    assert by[8] == [(by[8][0][0], 7, False)]
    assert sorted(by[None], key=str) == [(0, None, True), (1, 4, False)]
    stay = N.one_of_each(messy)
    assert stay.columns == messy.columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 10, 11, None]))


def test_one_row_of_repeated_ones_stays(spark):
    rows = [(3, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "other words are here now", "z"), (None, "lone words of no id", "p"),
            (None, "lone words of no id", "q"), (None, "more words of no id at all", "r"), (5, "", "s"), (5, "", "t")]
    got = N.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, k string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted(
        (str(d), t) for d, t in [(3, "a b c d e f"), (3, "other words are here now"), (None, "lone words of no id"),
                                 (None, "more words of no id at all"), (5, ""), (5, "")])


def test_empty_table(empty):
    assert N.near_duplicates(empty).count() == 0 and N.one_of_each(empty).count() == 0


def test_choosing_a_row_does_not_repeat_the_search(spark):
    """The plan that keeps one row each joins what was found, not the joins that found it."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l")], "doc_id long, text string")
    plan = N.one_of_each(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 6
