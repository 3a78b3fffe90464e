import random

import numpy as np

from credline.llm import ranked as R
from tests.llm import brute


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "Ärger", "ärger", "x1", "K", "é", "zz", "42", *(f"w{i}" for i in range(40))]
    text = lambda n: rng.choice([" ", ", ", "\n", "_-"]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 60]))) for i in range(120)]
    items = [(i % 17, text(rng.choice([1, 4, 30]))) for i in range(20)]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus(3)
    docs += [(500, None), (501, ""), (None, "the of w1 w2"), (None, "the of w1 w2"), (7, docs[7][1]), (502, "the " * 40_000 + "end")]
    items += [(90, None), (91, ""), (None, "the w1"), (92, "the THE of"), (93, "unknown words")]
    got = {}
    for limit in (R.BLOCK_TERMS, 40):  # one block, several blocks
        monkeypatch.setattr(R, "BLOCK_TERMS", limit)
        got[limit] = rows_of(R.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                                      spark.createDataFrame(items, "item_id long, text string")))
    assert got[40] == got[R.BLOCK_TERMS] == sorted(brute.ranked(docs, items), key=str)


def test_small_steps_give_the_same(spark, monkeypatch):
    docs, items = corpus(8)
    monkeypatch.setattr(R, "CELLS", 1)
    got = rows_of(R.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3))
    assert got == sorted(brute.ranked(docs, items, 3), key=str)


def test_shared_sets_are_added_up_once():
    """Items over shared term sets need fewer additions than their lengths, with equal sums."""
    rng = random.Random(1)
    shared = [[f"s{g}x{i}" for i in range(16)] for g in range(3)]
    texts = [" ".join([*rng.choice(shared), *rng.choice(shared), f"own{i}"]).encode() for i in range(40)]
    plan = R.Plan(texts)
    gain = np.random.default_rng(1).integers(0, 1000, (len(plan.dictionary), 9))
    want = np.array([sum(gain[plan.dictionary[t]] for t in R.terms(x)) for x in texts])
    assert (plan.scores(gain) == want).all()
    assert len(plan.rounds) >= 4
    assert len(plan.flat) + sum(map(len, plan.rounds)) < 0.3 * sum(len(set(R.terms(x))) for x in texts)


def test_messy_rows(messy, messy_rows, spark):
    items = [(1, "one two"), (2, "alpha mail"), (3, None)]
    want = sorted(brute.ranked([(r[0], r[1]) for r in messy_rows], items), key=str)
    assert rows_of(R.search(messy, spark.createDataFrame(items, "item_id long, text string"))) == want


def test_empty_tables(empty, documents, spark):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert R.search(empty, items).count() == 0
    none = R.search(documents, items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
