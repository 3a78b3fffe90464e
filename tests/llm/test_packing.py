import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from credline.llm import packing as P

PATH = P.tokenizer_path()


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids + [P.END_ID]


ODD = ["", "áb é  x", "ΑΣ ΑΣ\tx y\x1cz", "don't 'S it'll", "<|endoftext|> hi <|startoftext|>x", "x<|endoftext|>y",
       "  \n\n a", "KK ſ İI", "a § b §", "a§b", "12345 ½ ²", "\r\nfoo\r\nbar", "\U0001f600!?", "x" * 3000]


def test_encoder_is_the_tokenizer(tok, documents):
    texts = ODD + [r["text"] or "" for r in documents.select("text").limit(300).collect()]
    enc = P.Encoder(PATH)
    assert enc.plain
    for got, text in zip(enc(texts), texts):
        assert np.frombuffer(got, "<u4").tolist() == ids(tok, text)[:-1], text[:80]


@given(st.integers(1, 30_000))
def test_cuts(n):
    parts = list(P.cuts(n, 4096, 32))
    assert sum(x for x, _ in parts) == n and all(x * k <= 4096 for x, k in parts)
    assert all(4096 - x * k <= max(32, k) for x, k in parts)


def check(tok, rows, pieces):
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for d, t in rows:
        want = np.array(ids(tok, t), "<u4")
        at = 0
        for r in sorted(by_doc.pop(d), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(want[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    assert not by_doc
    held = padded = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        held += at
        padded += at if at & (at - 1) == 0 else 4096
    return padded / max(held, 1)


def test_whole_table(tok, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert check(tok, rows, P.digest(P.pack(documents.repartition(5), PATH)).collect()) < 1.01


def test_messy_rows(tok, messy, messy_rows):
    got = P.digest(P.pack(messy, PATH)).collect()
    assert sum(r["length"] for r in got) == sum(len(ids(tok, r[1])) for r in messy_rows)
    assert sorted(r["length"] for r in got if r["doc_id"] in (1, 2)) == [1, 1]


def test_small_capacity(spark, tok):
    docs = spark.createDataFrame([(i, "a b c d e f g " * (i % 7)) for i in range(40)], "doc_id long, text string").repartition(2)
    got = P.pack(docs, PATH, capacity=64, slack=2).collect()
    by = {}
    for r in got:
        by[r["sequence_id"]] = by.get(r["sequence_id"], 0) + r["length"]
    assert max(by.values()) <= 64 and sum(by.values()) == sum(7 * (i % 7) + 1 for i in range(40))


def test_empty_table(empty):
    assert P.pack(empty, PATH).count() == 0
