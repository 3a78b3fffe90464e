import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from credline.llm import convtrie as C
from tests.conftest import uncoalesced
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string, path string, d string, shard string"
COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(spark, rows, shard_turns=C.SHARD_TURNS):
    frame = spark.createDataFrame([(*r, "p", "d", "s") for r in rows], SCHEMA).repartition(3)
    got = C.trie(C.rebuilt(C.sequences(frame, "conv_id", "turn", "role", "text")), shard_turns).collect()
    out = [tuple(r[c] for c in COLS) for r in got]
    assert len(out) == len(set(out))
    return set(out)


def conversations(seed, n=70):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(-12, 0), 10**15, 10**15 + 2]:
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 1, 2, 4, 9, 30])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "bé", "long text"])))
    return rows


@pytest.mark.parametrize("shard_turns", [C.SHARD_TURNS, 60, 7])
def test_against_brute_force(spark, shard_turns):
    rows = conversations(shard_turns)
    with uncoalesced(spark):
        assert nodes(spark, rows, shard_turns) == brute.trie(rows)


def test_messy_rows(spark):
    rows = [(1, None, None, None), (1, 0, "", ""), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 5, "user", "y" * 200_000),
            (2, 5, "bot", None), (None, 0, "user", "lost"), (None, None, None, None), (5, 1, "user", "x"), (7, 0, "user", "only"),
            (25, 0, "a", "b"), (26, 0, "a", "b"), (27, 0, "a", "b"), (28, None, "a", "b")]
    for shard_turns in (C.SHARD_TURNS, 1):
        assert nodes(spark, rows, shard_turns) == brute.trie(rows)


def test_many_conversations_of_one_sequence(spark):
    """A hot sequence is one row of the tree; its members count and are hashed in full."""
    rows = [(c, 0, "user", "hello") for c in range(400)] + [(c, 1, "bot", "hi") for c in range(0, 400, 3)]
    for shard_turns in (C.SHARD_TURNS, 2):
        assert nodes(spark, rows, shard_turns) == brute.trie(rows)


def test_empty_table(spark):
    assert nodes(spark, []) == set() and nodes(spark, [(None, 0, "user", "x")]) == set()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.lists(st.integers(0, 5), max_size=6).map(tuple), min_size=1, max_size=40))
def test_tree_finds_every_sequence(paths):
    tree, paths = C.Tree(), sorted(paths)
    end = {p: None for p in paths}
    for i in C.medians(len(paths)):
        end[paths[i]] = tree.insert(list(paths[i]), [1] * len(paths[i]))
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert len(tree.key) == len(prefixes) and sorted(C.medians(len(paths))) == list(range(len(paths)))
    for p in paths:
        at, spelled = end[p], []
        while at:
            spelled.append(tree.key[at])
            assert tree.parent[at] < at
            at = tree.parent[at]
        assert tuple(spelled[::-1]) == p
