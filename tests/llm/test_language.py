import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from credline.llm import language as L


@given(st.text("abc", max_size=40), st.text("abcd", max_size=12))
def test_automaton_holds_exactly_the_substrings(text, word):
    state = L.automaton(text)
    for c in word:
        state = state.get(c) if state is not None else None
    assert (state is not None) == (word in text)


def plain_phrases(sample, text):
    """Longest matches, one after the other; what is left open at the end does not count."""
    n = i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[i:j + 1] in sample:
            j += 1
        if j == len(text):
            return n
        n, i = n + 1, max(j, i + 1)
    return n


@given(st.text("abc", min_size=1, max_size=30), st.text("abcd", max_size=40))
def test_phrases(sample, text):
    root = L.automaton(sample)
    state, n = L.phrases(root, text, root, 0)
    # a letter that the sample lacks ends the open phrase and stands for itself in one step
    want = plain_phrases(sample, text) if set(text) <= set(sample) else None
    assert want is None or n == want


def test_giving_up_does_not_change_the_winner():
    model = {"a": "ab" * 50 + "abc", "b": "cd" * 50 + "dca", "c": "xyz" * 20}
    parse = L.Parser(model)
    for text in ("abab" * 500, "cdcd" * 500 + "abab" * 400, "xyz" * 900 + "ab" * 1300, "a", "zz" * 3000):
        costs = {}
        for k, root, bits in zip(parse.names, parse.roots, parse.bits):
            costs[k] = (L.phrases(root, text, root, 0)[1] * bits, k)
        got, score = parse(text)
        assert got == min(costs.values())[1]
        assert math.isclose(score, 1 - costs[got][0] / parse.bits[parse.names.index(got)] / len(text))


def test_held_out_accuracy(documents):
    got = L.predict(documents, L.learn(documents)).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    known = [r for r in got if r["lang_pred"] != "und"]
    assert len(got) > 200 and len(known) >= len(got) - 5
    assert sum(r["lang"] == r["lang_pred"] for r in known) / len(known) > 0.95


def test_messy_rows(messy, messy_rows, documents):
    model = L.learn(documents)
    got = L.predict(messy, model).collect()
    assert len(got) == len(messy_rows)
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (1, 2, 3)} == {"und"}
    assert by[7]["lang_pred"] in model and all(0 <= r["score"] <= 1 for r in got)
    assert set(L.learn(messy)) <= {"en", "de", "fr", "es"}
    assert {r["lang_pred"] for r in L.predict(messy, {}).collect()} == {"und"}


def test_learning_is_bounded_and_repeats_do_not_count_twice(spark, documents):
    model = L.learn(documents.unionByName(documents))
    assert model == L.learn(documents) and max(map(len, model.values())) <= L.SAMPLE_CHARS


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(100 * j + i, f"{c * 3} {c * 2} {i} " * 40, f"l{c}") for j, c in enumerate("abcdefg") for i in range(20 - j)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    full = L.learn(docs)
    monkeypatch.setattr(L, "MAX_LANGUAGES", 3)
    monkeypatch.setattr(L, "SAMPLE_CHARS", 1_000)
    model = L.learn(docs)
    assert set(model) == set(full) == {f"l{c}" for c in "abcdefg"}
    assert sum(map(len, model.values())) <= 3 * 1_000
    got = L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


@pytest.mark.parametrize("text", [None, "", "12 %%", "\n"])
def test_no_letter(text):
    assert L.Parser({"en": "the and"})(text) == ("und", 0.0)


def test_empty_table(empty):
    assert L.learn(empty) == {} and L.predict(empty, {}).count() == 0
