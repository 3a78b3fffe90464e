"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and their openings (``PREFIXES``
characters), as 64-bit hashes. Learning, all of it on a bounded sample of labelled rows that
are not held out (at most about ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` other ones, those with
the smallest hashes of their ids):

1. document counts of every term by label (a Spark aggregate); terms seen in at least
   ``LEAST_ROWS`` toxic or clean sample rows whose rates differ clearly (log-likelihood ratio
   at least ``LEAST_G``) are kept, the ``TERMS`` strongest;
2. a factorization machine on these: bias, a weight per term (starting at half the log odds
   ratio of toxic terms), and per term a vector whose inner products weigh pairs of terms, so a
   pair can count more (or less) than its parts; full-batch Adagrad on the driver, with the
   sample's class ratio taken back out of the bias.

Scoring reads every whole text once; only distinct known terms enter a sum. Model size and
driver memory are bounded by the parameters; nothing else is collected.

Defined results: a null or empty text scores as one without known terms; so does every text if
there are no labels of both kinds (score 0 then); repeated labels of one id count as toxic if
one is; null ids and null labels are not learned from; repeated rows are scored each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credline.llm.common import fold, held_out, register, stored, table, with_python

TOXIC_ROWS = 4_000
CLEAN_ROWS = 8_000
PREFIXES = (4, 5, 6)
LEAST_ROWS = 4
LEAST_G = 12.0
TERMS = 4_096
FACTORS = 8
STEPS = 150
RATE = 0.3
THRESHOLD = 0.3
MEMO_WORDS = 300_000

SCORED = "doc_id long, held_out boolean, score double, predicted int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
_BLANK = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> set[bytes]:
    """Distinct lower-cased words (UTF-8); anything but ASCII letters and non-ASCII
    characters separates words."""
    return set((text or "").lower().encode().translate(_BLANK).split())


def word_terms(word: bytes) -> list[int]:
    """Signed 64-bit hashes of the word and of its openings."""
    text = word.decode()
    keys = {"=" + text} | {text[:n] for n in PREFIXES if len(text) >= n}
    return [int(np.uint64(xxhash.xxh3_64_intdigest(k)).astype(np.int64)) for k in sorted(keys)]


def terms(text: str | None) -> set[int]:
    return {h for w in words(text) for h in word_terms(w)}


def sample_ids(labels: DataFrame, id_col: str, label_col: str) -> tuple[dict[int, int], dict[int, int]]:
    """label by id of the learning sample (about TOXIC_ROWS + CLEAN_ROWS ids), and the
    labelled rows of either kind."""
    rows = (labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y"))
            .filter("i is not null and y is not null").filter(fold("i") != 2)
            .groupBy("i").agg(F.max((F.col("y") == 1).cast("int")).alias("y")))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}, n
    bits = 1 << 30
    cut = {1: min(bits, TOXIC_ROWS * bits // n[1]), 0: min(bits, CLEAN_ROWS * bits // n[0])}
    at = F.pmod(F.xxhash64("i"), F.lit(bits))
    return {r["i"]: r["y"] for r in rows.filter(F.when(F.col("y") == 1, at < cut[1]).otherwise(at < cut[0])).collect()}, n


def fit_fm(rows: list[np.ndarray], y: np.ndarray, n_terms: int, prior: float,
           factors: int = FACTORS, steps: int = STEPS, l2: float = 1e-3, start: np.ndarray | None = None) -> dict:
    """w0 + sum w_i + sum_{i<j} <v_i, v_j> over the terms of a row, logistic loss. ``prior``
    is log(odds in the corpus / odds in the sample), added to the bias; ``start`` the weights
    to begin with (terms that mostly come together would otherwise share one term's weight)."""
    rng = np.random.default_rng(7)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ix = np.concatenate(rows).astype(np.int64) if len(at) else np.empty(0, np.int64)
    n = len(rows)
    p = {"w0": np.full(1, np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))), "w": np.zeros(n_terms) if start is None else start.copy(), "v": rng.normal(0, 0.05, (n_terms, factors))}
    seen = {k: np.full_like(v, 1e-6) for k, v in p.items()}
    for _ in range(steps):
        z = p["w0"][0] + np.bincount(at, p["w"][ix], n)
        totals = []
        for f in range(factors):  # one factor at a time: no array is larger than the sample's terms
            own = p["v"][ix, f]
            totals.append(np.bincount(at, own, n))
            z += 0.5 * (totals[f]**2 - np.bincount(at, own**2, n))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        slope = np.stack([np.bincount(ix, g[at] * (totals[f][at] - p["v"][ix, f]), n_terms) for f in range(factors)], 1)
        grads = {"w0": np.array([g.sum()]), "w": np.bincount(ix, g[at], n_terms),
                 "v": slope + l2 * p["v"] / n_terms}
        for k, d in grads.items():
            seen[k] += d**2
            p[k] = p[k] - RATE * d / np.sqrt(seen[k])
    return {"w0": float(p["w0"][0] + prior), "w": p["w"], "v": p["v"]}


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> dict | None:
    """The model: {"terms": {hash: index}, "w0", "w", "v"}; None without labels of both kinds."""
    ids, counts = sample_ids(labels, id_col, label_col)
    if not ids:
        return None

    def extract(batches):
        for batch in batches:
            i = batch.column(0).to_pylist()
            got = [sorted(terms(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array([ids[x] for x in i], pa.int32()),
                                              pa.array(got, pa.list_(pa.int64()))], names=["i", "y", "terms"])

    chosen = sorted(ids)  # bounded: TOXIC_ROWS + CLEAN_ROWS
    wanted = docs.sparkSession.createDataFrame([(x,) for x in chosen], "i long")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    rows = (rows.join(F.broadcast(wanted), "i", "left_semi")  # one row an id, whatever their number
            .groupBy("i").agg(F.min_by("t", F.xxhash64("t")).alias("t")))
    sample = stored(with_python(rows).mapInArrow(extract, "i long, y int, terms array<long>"), "toxicity-sample")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    n1, n0 = float(n[1]), float(n[0])
    t = (sample.select("y", F.explode("terms").alias("term")).groupBy("term")
         .agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter(F.greatest("a", "b") >= LEAST_ROWS))
    a, b = F.col("a"), F.col("b")
    ea, eb = (a + b) * (n1 / (n1 + n0)), (a + b) * (n0 / (n1 + n0))
    part = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(0.0)
    kept = (t.withColumn("g", 2 * (part(a, ea) + part(b, eb))).filter(F.col("g") >= LEAST_G)
            .orderBy(F.desc("g"), "term").limit(TERMS).select("term", "a", "b").collect())
    odds = np.array([np.log((r["a"] + 0.5) / (n1 + 1)) - np.log((r["b"] + 0.5) / (n0 + 1)) for r in kept])
    index = {r["term"]: j for j, r in enumerate(kept)}
    at = np.argsort(np.fromiter(index, np.int64, len(index)))
    known = np.fromiter(index, np.int64, len(index))[at]

    def keep(batches):
        """The kept terms of each row as packed indices: a few bytes a term for the driver."""
        for batch in batches:
            packed = []
            for terms_of in batch.column(2):
                x = terms_of.values.to_numpy()
                x = x[np.isin(x, known)]
                packed.append(at[np.searchsorted(known, x)].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["i", "y", "ix"])

    found = sample.select("i", "y", "terms").mapInArrow(keep, "i long, y int, ix binary").orderBy("i").collect()
    fit = fit_fm([np.frombuffer(r["ix"], "<i4") for r in found], np.array([r["y"] for r in found], float), len(index),
                 float(np.log(counts[1] / counts[0]) - np.log(n1 / n0)), start=np.maximum(odds, 0) / 2)
    return {"terms": index, **fit}


class Scorer:
    """Scores of whole texts; remembers the known terms of words it has met."""

    def __init__(self, model: dict | None):
        self.model, self.known = model, {}

    def __call__(self, text: str | None) -> float:
        if self.model is None:
            return 0.0
        known, found = self.known, set()
        if len(known) > MEMO_WORDS:
            known.clear()
        for w in words(text):
            ix = known.get(w)
            if ix is None:
                ix = known[w] = tuple(j for h in word_terms(w) if (j := self.model["terms"].get(h)) is not None)
            if ix:
                found.update(ix)
        z = self.model["w0"]
        if found:
            at = np.fromiter(sorted(found), np.int64)
            v = self.model["v"][at]
            z += self.model["w"][at].sum() + 0.5 * ((v.sum(0)**2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    def run(batches):
        of = Scorer(model)
        for batch in batches:
            s = np.array([of(t) for t in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s),
                                              pa.array((s >= threshold).astype("i4"))], schema=_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    return with_python(rows).mapInArrow(run, SCORED)


def without_toxic(docs: DataFrame, model: dict | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    at = docs.columns.index(text_col)

    def run(batches):
        of = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([of(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return with_python(docs).mapInArrow(run, docs.schema)


@register("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
