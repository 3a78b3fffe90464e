import random

import numpy as np
import pytest

from credline.llm import ngramjoin as N
from tests.conftest import uncoalesced
from tests.llm import brute
from tests.llm.test_neardup import groups


def found(docs, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.linked_components(docs, **options).collect()}


@pytest.mark.parametrize("chunk,group", [(8_000_000, 2_000_000), (2_000, 150)])
def test_against_brute_force(spark, monkeypatch, chunk, group):
    """The second case deals texts over many chunks and ranges and every group over blocks."""
    monkeypatch.setattr(N, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(N, "GROUP", group)
    rows = groups(chunk) + [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "İ ſ K"), (10_004, "a b c d e"), (10_005, "A b c d E")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs) == brute.near_dup(rows, 80)


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert found(documents) == brute.near_dup(rows, 80)


def test_common_lines_and_chains(spark):
    """Documents made of common lines share prefixes without being linked; a chain of small
    changes is one component whose ends are not linked."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    lines = [" ".join(word() for _ in range(9)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    ws = [word() for _ in range(100)]
    for i in range(30):
        ws[i * 3] = word()
        rows.append((1000 + i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.near_dup(rows, 80)
    assert found(docs) == want and {want[1000 + i][1] for i in range(30)} == {1000}


@pytest.mark.parametrize("threshold", [50, 80, 100])
def test_forest_connects_what_is_linked(threshold):
    rng = np.random.default_rng(threshold)
    base = np.unique(rng.integers(0, 1 << 62, 120, dtype=np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(base, int(k), replace=False), rng.integers(0, 1 << 62, int(m), dtype=np.uint64))))
            for k, m in zip(rng.integers(1, 120, 80), rng.integers(0, 30, 80))]
    sets += [base, base[:-1], base[:60], base[:60].copy()]
    linked = lambda a, b: 100 * (i := len(np.intersect1d(a, b))) >= threshold * (len(a) + len(b) - i)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if linked(sets[a], sets[b])]
    tree = N.PrefixTree(sets, threshold)
    assert {(max(a, b), min(a, b)) for a in range(len(sets)) for b in tree.linked(a)} == set(pairs)

    def parts(edges):
        of = list(range(len(sets)))
        for a, b in edges:
            x, y = of[a], of[b]
            of = [x if z == y else z for z in of]
        return [of.index(x) for x in of]
    edges = list(N.link_forest(sets, threshold))
    assert all(linked(sets[a], sets[b]) for a, b in edges) and len(edges) < len(sets)
    assert parts(edges) == parts(pairs)


def test_a_joined_start_is_one_component():
    sets = [np.arange(i, i + 20, dtype=np.uint64) for i in range(10)]
    assert sorted(v for _, v in N.link_forest(sets, 80, joined=[0, 9])) == list(range(1, 9))


def test_frequency_bytes_keep_the_order():
    df = np.unique(np.geomspace(1, 1e9, 5000).astype(np.int64))
    assert (np.diff(N.codes(df).astype(int)) >= 0).all() and N.codes(df[:100]).tolist() == df[:100].tolist()


def test_ranges_cut_the_hash_space_in_order():
    tokens = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 10_000, dtype=np.uint64))
    for ranges in (1, 7, 1000):
        r, place = N._placed(tokens, ranges)
        want = [int(t) * ranges >> 64 for t in tokens]
        assert r.tolist() == want
        assert place.tolist() == [(int(t) * ranges >> 32) & 0xFFFFFFFF for t in tokens]


def test_hot_group_needs_no_pairs_of_its_linked_blocks(spark, monkeypatch):
    """Near copies that are linked with their pivot meet it only: no block pairs are made."""
    monkeypatch.setattr(N, "GROUP", 400)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1:]])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with uncoalesced(spark):
        assert set(found(docs).values()) == {(196, 0)}


def test_messy_rows(messy, messy_rows):
    got = N.linked_components(messy).collect()
    assert len(got) == len(messy_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[1] == [(0, 1)] and by[3] == [(0, 3)] and by[4] == [(1, 4)] and by[9] == [(1, 4)] * 2
    assert by[8] == [(by[8][0][0], 7)]
    assert sorted(by[None], key=str) == [(0, None), (1, 4)]


def test_empty_table(empty):
    assert N.linked_components(empty).count() == 0
