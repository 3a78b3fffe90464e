import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from credline.llm import suffixdedup as S
from tests.llm import brute


@given(st.lists(st.lists(st.binary(min_size=S.ROW, max_size=S.ROW) | st.sampled_from([b"a" * S.ROW, b"a" * 79 + b"b"]), min_size=1, max_size=8), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_merge_sorts_front_coded_runs(lists):
    runs = []
    for strings in map(sorted, lists):
        own, rest, ends, before = [], b"", [], None
        for s in strings:
            n = 0 if before is None else next((i for i in range(S.ROW) if s[i] != before[i]), S.ROW)
            own.append(n)
            rest += s[n:]
            ends.append(len(rest))
            before = s
        runs.append((bytes(own), ends, rest))
    got = list(S.merge(runs))
    assert [x for _, x, _, _ in got] == sorted(s for strings in lists for s in strings)
    for (_, a, _, _), (n, b, _, _) in zip(got, got[1:]):
        assert n == next((i for i in range(S.ROW) if a[i] != b[i]), S.ROW)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["ab", "cde", "éf", "ghij", "漢", "\U0001f600", "k"]
    phrase = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [phrase(40) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [phrase(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 20)
            parts += [s[a:a + rng.randint(30, 120)], phrase(rng.randint(0, 6))]
        rows.append((i * 3 % n if n % 3 else i, " ".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 400), (n + 3, "x" * 49), (n + 4, "x" * 50), (n + 5, "xy" * 300)]
    return rows


@pytest.mark.parametrize("chunk,group", [(1 << 24, 50_000), (700, 50_000), (700, 2)])
def test_against_brute_force(spark, chunk, group):
    rows = texts(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in S.remove_repeats(docs, chunk_bytes=chunk, group=group).collect()}
    want = brute.repeats(rows)
    assert got.keys() == want.keys()
    for d, (kept, spans) in want.items():
        r = got[d]
        assert (bytes(r["kept"]), r["n_spans"]) == (kept, spans), d
        assert r["n_bytes"] - r["n_removed"] == len(kept)


def test_hot_grams_stay_out_of_the_ranges(spark, monkeypatch):
    passage = "the passage that one third of all documents hold, whatever stands around it, " * 2
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(30))
    rows = [(i, f"{word()} {word()} {passage}{word()} {word()}" if i % 3 == 0 else f"{word()} {word()}") for i in range(90)]
    stages, plain = {}, S.stored
    monkeypatch.setattr(S, "stored", lambda df, name, *a: stages.setdefault(name, plain(df, name, *a)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_spans"]) for r in S.remove_repeats(docs, chunk_bytes=2000, group=5).collect()}
    assert got == brute.repeats(rows)
    large = stages["suffix-answers"].filter("w is not null")
    assert large.count() > 0 and large.count() == large.select("chunk", "w").distinct().count()


def test_messy_rows(messy, messy_rows):
    got = S.remove_repeats(messy).collect()
    assert len(got) == len(messy_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_removed"] for r in by[9]] == [0, 0]  # rows of one id keep each other, and these are short
    assert by[7][0]["n_removed"] == 0 and by[8][0]["n_removed"] > 900_000
    assert all(r["n_bytes"] == len((t[1] or "").encode()) for t in messy_rows for r in by[t[0]] if t[0] not in (None, 9))


def test_null_ids_are_largest(spark):
    text = "some words that are repeated and make fifty bytes or a bit more than that"
    docs = spark.createDataFrame([(None, text), (5, text), (None, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in S.remove_repeats(docs).collect()) == [
        (False, 0), (True, len(text)), (True, len(text))]


def test_empty_table(empty):
    assert S.remove_repeats(empty).count() == 0
