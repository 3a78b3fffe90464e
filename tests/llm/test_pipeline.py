"""The pipeline against its stages written out plainly, on whole small tables."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from credline.llm import packing, pii, toxicity
from tests.conftest import SF001
from tests.llm import brute
from tests.llm.test_decontaminate import brute as plain_hits
from tests.llm.test_pii import told


def blanked(rows):
    """The texts with base spans and telling terms blanked, written plainly."""
    terms = {}
    for d, a, b, gone in told(rows):
        terms.setdefault(d, []).append((a, 4, b, gone))
    out = {}
    for d, t in rows:
        spans = sorted([(*s, False) for s in brute.pii_base(t)] + terms.get(d, []))
        text, at = "", 0
        for a, k, b, gone in spans:
            if a >= at:
                text += t[at:a] + ("" if gone else f"[{pii.KINDS[k].upper()}]")
            at = max(at, b)
        out[d] = None if t is None else text + t[at:]
    return out


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.learn(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    score = toxicity.Scorer(model)
    rows = [(d, t) for d, t in texts.items() if score(t) < toxicity.THRESHOLD]
    seen = [set(d for d, _ in rows)]
    near = brute.near_dup(rows)
    rows = [(d, t) for d, t in rows if near[d][1] == d]
    seen.append(set(d for d, _ in rows))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    hit = {x[0] for x in plain_hits(rows, items) if x[2]}
    rows = [(d, t) for d, t in rows if d not in hit]
    seen.append(set(d for d, _ in rows))
    want = blanked(rows)

    at = docs
    for (name, stage), ids in zip(P.STAGES[:3], seen):
        at = P.stored(stage(spark, at, SF001), name)
        assert at.columns == docs.columns
        assert {r["doc_id"] for r in at.select("doc_id").collect()} == ids, name
    at = P.stored(P.STAGES[3][1](spark, at, SF001), "pii")
    assert at.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in at.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in at.collect())
    assert len(seen[1]) < len(seen[0]) and hit  # stages that had something to do

    tok = Tokenizer.from_file(packing.tokenizer_path())
    pieces = P.run(spark, SF001).collect()
    assert {r["doc_id"] for r in pieces} == set(want)
    for d, t in want.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        own = sorted((r for r in pieces if r["doc_id"] == d), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own]).tolist()[:-1]
        assert sum(r["length"] for r in own) == len(ids)
        assert all(zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)


@pytest.fixture
def folder(spark, messy, tmp_path):
    def write(docs):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(5, 1, 1), (None, 0, 1), (7, None, None), *[(i, 1, 0) for i in (1, 2, 3, 4, 6, 7, 9, 10, 11) for _ in range(2)]],
                              "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([(1, "alpha beta gamma delta epsilon alpha beta gamma delta epsilon"), (None, None), (2, "")],
                              "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)
    return write


def test_messy_rows(spark, messy, folder):
    messy = messy.filter("text is null or length(text) < 100000")  # long texts: the operators' own tests
    sf = folder(messy)
    at = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in P.STAGES:
        at = P.stored(stage(spark, at, sf), name)
        counts.append(at.count())
        if name != "packing":
            assert at.columns == messy.columns
    # of 12 rows the three further copies of "one two" go
    assert counts[:4] == [12, 9, 9, 9]
    assert set(r["doc_id"] for r in at.collect()) == {1, 2, 3, 4, 5, 6, 10, 11, None}


def test_empty_table(spark, empty, folder):
    assert P.run(spark, folder(empty)).count() == 0
