"""Ranked lexical search for many queries at once, by common subexpressions.

1. The documents are read once. Each becomes its accumulator: its number of terms and, for every
   term that any item holds, how often it occurs. These rows are written once.
2. The corpus counts (N, L, df) are sums over all accumulators.
3. An item's score is a sum over its (term, times) elements. Elements that stand together in
   several items are mined round by round: the pairs held by most items become nodes of their
   own, then pairs of those, so that a node of round r is a set of up to 2**r terms. Items and
   nodes form a DAG in which every shared set is one node.
4. For each run of documents the leaves of the DAG are filled from the accumulators, every node
   is added up once from its two parts, and the items combine what is left of them. A task keeps
   the best ``k`` per item; the tasks' best are ranked by a window, in two steps.

Items go in blocks of at most ``BLOCK_TERMS`` terms (an item that has more is a block by itself), so
the driver and a task hold one block's dictionary and DAG, whatever the size of the item table. All
documents meet every block; nothing is skipped. Mining looks for pairs within runs of ``RUN``
elements of an item, which bounds its work and changes no score.

Defined results: a null or blank text has no terms, does not count in N and is never found; a null
or termless item has no rows; every row of the item table is an item of its own, also where
ids repeat or are null; every document row is ranked for itself, rows of equal score by
ascending id, null ids last; texts are read whole, whatever their length; other columns are
ignored; an empty table gives no rows. Scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credline.llm.common import partition_id, register, stored, table, with_python

K = 10
BLOCK_TERMS = 65_536
RUN = 512
CELLS = 4_000_000  # numbers that a task holds at once while it scores
SALT = 64

# every byte but digits, letters and the bytes of non-ASCII characters separates terms; A-Z become a-z
_SEEN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()

ACCUMULATOR = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("tfs", pa.binary())])
BEST = pa.schema([("item", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in their order."""
    return (text or b"").translate(_SEEN).split()


def accumulators(docs: DataFrame, id_col: str, text_col: str, dictionary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, ids, tfs: the terms of the dictionary that a document holds, as packed int32."""

    def run(batches):
        get = dictionary.get
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids, tfs = [], [], []
                for text in part.column(1).to_pylist():
                    words = terms(text)
                    known = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                    own, times = np.unique(known[known >= 0], return_counts=True)
                    n.append(len(words))
                    ids.append(own.astype("<i4").tobytes())
                    tfs.append(times.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                                                  pa.array(tfs, pa.binary())], schema=ACCUMULATOR)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return with_python(rows).mapInArrow(run, "doc_id long, n long, ids binary, tfs binary")


def corpus_counts(acc: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each of the ``size`` terms."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            df += np.bincount(ids, minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], names=["term", "df"])

    total = acc.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    df = np.zeros(size, np.int64)
    for r in acc.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the block
        df[r["term"]] = r["df"]
    return total["N"], total["L"], df


def sharing_dag(items: list[list[int]], n_leaves: int) -> tuple[list[np.ndarray], list[list[int]]]:
    """Mine the element sets that items share. Returns the rounds (arrays of the two parts of each
    new node; nodes are numbered on from ``n_leaves``) and each item's remaining elements."""
    rest, rounds, top = [sorted(x) for x in items], [], n_leaves
    while True:
        pairs: Counter = Counter()
        common = Counter(e for x in rest for e in x)
        for x in rest:
            x.sort(key=lambda e: (-common[e], e))  # elements that many items hold come together
            for at in range(0, len(x), RUN):
                run = [e for e in x[at:at + RUN] if common[e] > 1]
                pairs.update((a, b) for i, a in enumerate(run) for b in run[i + 1:])
        made, used = {}, set()
        for (a, b), _ in sorted((p for p in pairs.items() if p[1] > 1), key=lambda p: (-p[1], p[0])):
            if a not in used and b not in used:  # one new node per element and round
                made[a, b] = top + len(made)
                used |= {a, b}
        if not made:
            return rounds, rest
        partner = {a: b for a, b in made}
        for i, x in enumerate(rest):
            own = set(x)
            for a in x:
                b = partner.get(a)
                if b is not None and b in own:
                    own -= {a, b}
                    own.add(made[a, b])
            rest[i] = sorted(own)
        rounds.append(np.array(list(made), np.int64))
        top += len(made)


class Plan:
    """A block of items: its dictionary, its leaves (term, times) and its DAG."""

    def __init__(self, texts: list[bytes | None]):
        counts = [Counter(terms(t)) for t in texts]
        self.dictionary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        leaves: dict[tuple[int, int], int] = {}
        elements = [[leaves.setdefault((self.dictionary[t], m), len(leaves)) for t, m in sorted(c.items())] for c in counts]
        self.term, self.times = np.array(list(leaves), np.int64).reshape(-1, 2).T
        self.rounds, rest = sharing_dag(elements, len(leaves))
        self.named = np.array([i for i, x in enumerate(rest) if x], np.int64)  # items with terms
        self.flat = np.array([e for x in rest for e in x], np.int64)
        self.starts = np.cumsum([0, *(len(x) for x in rest if x)])[:-1].astype(np.int64)
        self.nodes = len(leaves) + sum(len(r) for r in self.rounds)

    def scores(self, gain: np.ndarray) -> np.ndarray:
        """Items x documents from the terms' gains (terms x documents)."""
        out = np.empty((self.nodes, gain.shape[1]), np.int64)
        at = len(self.term)
        out[:at] = gain[self.term] * self.times[:, None]
        for r in self.rounds:
            out[at:at + len(r)] = out[r[:, 0]] + out[r[:, 1]]
            at += len(r)
        return np.add.reduceat(out[self.flat], self.starts, axis=0)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _best(plan: Plan, weight: np.ndarray, n_docs: int, length: int, k: int):
    """mapInArrow function over accumulators: the partition's best k of each item."""
    size = len(weight)
    step = max(1, CELLS // max(1, plan.nodes + len(plan.flat) + size))

    def chunks(batches) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield part.column(0), part.column(1).to_numpy(), part.column(2).to_pylist(), part.column(3).to_pylist()

    def run(batches):
        held = {}  # item -> best scores, ids and null marks, best first
        least = np.zeros(len(plan.named), np.int64)
        for doc_ids, n, ids, tfs in chunks(batches):
            sizes = [len(x) // 4 for x in ids]
            tf = np.zeros((size, len(n)), np.int64)
            tf[np.frombuffer(b"".join(ids), "<i4"), np.repeat(np.arange(len(n)), sizes)] = np.frombuffer(b"".join(tfs), "<i4")
            m = 25 + (75 * n * n_docs) // length
            score = plan.scores(weight[:, None] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)))
            none = doc_ids.is_null().to_numpy(zero_copy_only=False)
            name = doc_ids.fill_null(0).to_numpy()
            near = (score > 0) & (score >= least[:, None])
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                at = near[i]
                s, v, z = score[i, at], name[at], none[at]
                if i in held:
                    s, v, z = (np.concatenate(x) for x in zip(held[i], (s, v, z)))
                top = np.lexsort((v, z, -s))[:k]
                held[i] = s[top], v[top], z[top]
                if len(top) == k:
                    least[i] = s[top[-1]]
        for i, (s, v, z) in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(s), plan.named[i], np.int32)), pa.array(np.full(len(s), partition_id() % SALT, np.int32)),
                pa.array(v, mask=z), pa.array(s)], schema=BEST)
    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` the k best documents."""
    spark = docs.sparkSession
    rows = stored(items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text")), "items")
    out = None
    for names, plan in _blocks(rows):
        best = _block_best(docs, id_col, text_col, plan, k)
        ids = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {rows.schema['item_id'].dataType.simpleString()}")
        best = stored(best.join(ids, "item").select("item_id", "rank", "doc_id", "score"), "item-ranks")
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = rows.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out


def _blocks(rows: DataFrame) -> Iterator[tuple[list, Plan]]:
    """Blocks of items, read from their table one partition at a time."""
    names, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        text = None if r["text"] is None else bytes(r["text"])
        own = len(set(terms(text)))
        if names and size + own > BLOCK_TERMS:
            yield names, Plan(texts)
            names, texts, size = [], [], 0
        names.append(r["item_id"])
        texts.append(text)
        size += own
    if size:
        yield names, Plan(texts)


def _block_best(docs: DataFrame, id_col: str, text_col: str, plan: Plan, k: int) -> DataFrame:
    """item (its number in the block), rank, doc_id, score."""
    acc = stored(accumulators(docs, id_col, text_col, plan.dictionary), "accumulators")
    n_docs, length, df = corpus_counts(acc, len(plan.dictionary))
    best = acc.filter("n > 0").mapInArrow(_best(plan, weights(n_docs, df), n_docs, max(1, length), k),
                                          "item int, part int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", "part"], ["item"]):  # the tasks' best meet in two steps
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("item", "rank", "doc_id", "score")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as ws from documents),
s as (select count(*) filter (len(ws) > 0) as docs, sum(len(ws))::bigint as words from d),
i as (select row_number() over () as q, item_id, {_TERMS} as ws from benchmark),
e as (select q, item_id, term, count(*) as times from (select q, item_id, unnest(ws) as term from i) group by all),
v as (select distinct term from e),
tf as (select r, term, count(*) as tf from (select r, unnest(ws) as term from d) semi join v using (term) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*) as df from tf group by term), s),
m as (select r, doc_id, 25 + (75 * len(ws)::bigint * docs) // words as m from d, s where len(ws) > 0),
p as (select q, any_value(item_id) as item_id, r, any_value(doc_id) as doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from tf join w using (term) join m using (r) join e using (term) group by q, r),
o as (select item_id, row_number() over (partition by q order by score desc, doc_id nulls last)::int as rank, doc_id, score
  from p where score > 0)
select item_id, rank, doc_id, score from o where rank <= {K}
"""


@register("op13_ranked", OP13_SQL)
def op13_ranked(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
