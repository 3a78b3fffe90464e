"""Exact top-k search by inner product with a KD-tree per shard.

Vectors become integers floor(scale * x). They are dealt over shards by a hash of their id;
each shard's task builds a KD-tree: median splits along the widest side, a tight bounding box
and the smallest id per node. No query can score more in a node than the sum over components
of max(q*lo, q*hi), so a best-first walk may stop at the first node whose bound is below the
kth score found so far (equal bounds are followed while the node holds a smaller id).

Each query first searches the shard it lives in. Its kth (score, id) found there travels with
it to every other shard and prunes from the first node on; a shard returns only what beats it.
Queries travel in blocks (one per home shard): a task holds one tree and ``BLOCKS`` query
blocks, whatever the number of queries. Results are ranked by a window per query.

Defined results: a null vector, or one holding a null or non-finite component, and a null id
take no part; vectors only meet vectors of their own length; the empty vector scores 0;
a query never returns its own id, so of repeated rows of one id none returns the other, and
each repeated id is searched once; ties go to the smaller id; other columns are ignored; an
empty table gives no rows. Scores are exact: doubles while all sums stay below 2**53, Python
integers beyond.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from credline.llm.common import register, stored, table, with_python

K = 20
SCALE = 64
EVERY = 20
SHARD_ROWS = 4096
LEAF_ROWS = 256
BLOCKS = 16

TREE = ("dim int, shard int, n long, ids binary, vecs binary, start binary, stop binary, child binary, "
        "least binary, lo binary, hi binary")
FOUND = "query_id long, vec_id long, score long"


def quantised(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long): the rows that take part."""
    x = F.col(vec_col)
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return (rows.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(ok)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long")).alias("v")))


def build_tree(ids: np.ndarray, vecs: np.ndarray) -> dict:
    """Nodes in creation order; ``child`` is the first of two children, 0 for a leaf."""
    order = np.arange(len(ids))
    start, stop, child, least, lo, hi = [0], [len(ids)], [0], [], [], []
    at = 0
    while at < len(start):
        a, b = start[at], stop[at]
        own = vecs[order[a:b]]
        low, high = own.min(axis=0), own.max(axis=0)
        lo.append(low)
        hi.append(high)
        least.append(ids[order[a:b]].min())
        side = (high - low).argmax() if own.shape[1] else 0
        if b - a > LEAF_ROWS and own.shape[1] and high[side] > low[side]:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], mid)]
            child[at] = len(start)
            for x, y in ((a, a + mid), (a + mid, b)):
                start.append(x)
                stop.append(y)
                child.append(0)
        at += 1
    return {"ids": ids[order], "vecs": vecs[order], "start": np.array(start), "stop": np.array(stop),
            "child": np.array(child), "least": np.array(least), "lo": np.array(lo), "hi": np.array(hi)}


def _tree_row(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["vec_id"].to_numpy(np.int64)
    dim = int(pdf["dim"].iloc[0])
    vecs = np.array(pdf["v"].tolist(), dtype=np.int64).reshape(len(ids), dim)
    order = np.lexsort((*vecs.T[::-1], ids)) if dim else np.argsort(ids)  # the same tree from any arrival order
    tree = build_tree(ids[order], vecs[order])
    return pd.DataFrame([{"dim": dim, "shard": int(pdf["shard"].iloc[0]), "n": len(ids),
                          **{k: v.astype("<i8").tobytes() for k, v in tree.items()}}])


def _tree(row) -> dict:
    get = lambda k: np.frombuffer(row[k], "<i8")
    t = {k: get(k) for k in ("ids", "start", "stop", "child", "least")}
    t |= {k: get(k).reshape(-1, row["dim"]) for k in ("vecs", "lo", "hi")} if row["dim"] else {
        "vecs": np.zeros((len(t["ids"]), 0), np.int64), "lo": np.zeros((len(t["start"]), 0), np.int64),
        "hi": np.zeros((len(t["start"]), 0), np.int64)}
    return t


def _number(tree: dict, queries: np.ndarray):
    """The number type in which every score is exact."""
    most = max((int(np.abs(x.astype(object)).max()) if x.size else 0) for x in (tree["lo"], tree["hi"]))
    own = int(np.abs(queries.astype(object)).max()) if queries.size else 0
    return np.float64 if most * own * max(1, queries.shape[1]) < 1 << 53 else object


def search(tree: dict, query_ids: np.ndarray, queries: np.ndarray, kth: list, k: int) -> list[tuple]:
    """(query id, vec id, score) of the at most k best of the tree that beat each query's
    ``kth`` (score, id), or of the k best where that is None."""
    kind = _number(tree, queries)
    q, vecs, lo, hi = (x.astype(kind) for x in (queries, tree["vecs"], tree["lo"], tree["hi"]))
    zero = np.zeros_like(q)
    bounds = np.maximum(q, zero) @ hi.T + np.minimum(q, zero) @ lo.T
    ids, start, stop, child, least = (tree[x] for x in ("ids", "start", "stop", "child", "least"))
    out = []
    for i, own in enumerate(query_ids.tolist()):
        b, limit = bounds[i], kth[i]
        top_s, top_i = np.empty(0, kind), np.empty(0, np.int64)
        heap = [(-b[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            bound = -bound
            if limit is not None and bound < limit[0]:
                break
            if limit is not None and bound == limit[0] and least[node] >= limit[1]:
                continue
            if c := int(child[node]):
                heapq.heappush(heap, (-b[c], c))
                heapq.heappush(heap, (-b[c + 1], c + 1))
                continue
            s = vecs[start[node]:stop[node]] @ q[i]
            near = ids[start[node]:stop[node]]
            keep = near != own
            if limit is not None:
                keep &= (s > limit[0]) | ((s == limit[0]) & (near < limit[1]))
            if not keep.any():
                continue
            top_s, top_i = np.concatenate([top_s, s[keep]]), np.concatenate([top_i, near[keep]])
            best = np.lexsort((top_i, -top_s))[:k]
            top_s, top_i = top_s[best], top_i[best]
            if len(best) == k:
                limit = (top_s[-1], top_i[-1])
        out += [(own, int(v), int(s)) for s, v in zip(top_s, top_i)]
    return out


def top_k(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
          every: int = EVERY, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k
    best other rows."""
    spark = rows.sparkSession
    vectors = quantised(rows, id_col, vec_col, scale)
    shards = max(1, -(-rows.count() // shard_rows))
    keyed = vectors.withColumns({"dim": F.size("v"), "shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")})
    trees = stored(with_python(keyed).groupBy("dim", "shard").applyInPandas(_tree_row, TREE), "kd-trees")

    def home(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                tree = _tree(row)
                mine = np.flatnonzero(tree["ids"] % every == 0)
                mine = mine[np.unique(tree["ids"][mine], return_index=True)[1]]
                q_ids, qs = tree["ids"][mine], tree["vecs"][mine]
                found = pd.DataFrame(search(tree, q_ids, qs, [None] * len(q_ids), k), columns=["q", "v", "s"])
                worst = found.groupby("q").agg(n=("v", "size"), s=("s", "last"), v=("v", "last"))
                worst = worst.reindex(q_ids)
                full = (worst["n"] == k).to_numpy()
                yield pd.DataFrame([{"dim": row["dim"], "shard": row["shard"], "q_ids": q_ids.tobytes(),
                                     "qs": qs.astype("<i8").tobytes(), "full": full.astype("u1").tobytes(),
                                     "kth_s": worst["s"].fillna(0).to_numpy("<i8").tobytes(),
                                     "kth_v": worst["v"].fillna(0).to_numpy("<i8").tobytes(),
                                     "found_q": found["q"].to_numpy("<i8").tobytes(),
                                     "found_v": found["v"].to_numpy("<i8").tobytes(),
                                     "found_s": found["s"].to_numpy("<i8").tobytes()}])

    blocks = stored(trees.mapInPandas(home, "dim int, shard int, q_ids binary, qs binary, full binary, kth_s binary, "
                                            "kth_v binary, found_q binary, found_v binary, found_s binary"), "kd-queries")

    def unpack(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield pd.DataFrame({c: np.frombuffer(row[b], "<i8") for c, b in (
                    ("query_id", "found_q"), ("vec_id", "found_v"), ("score", "found_s"))})

    def away(key, tree_rows, query_rows):
        out = []
        for row in tree_rows.to_dict("records"):
            tree = _tree(row)
            for block in query_rows.to_dict("records"):
                if block["home"] == row["shard"]:
                    continue
                q_ids = np.frombuffer(block["q_ids"], "<i8")
                qs = np.frombuffer(block["qs"], "<i8").reshape(len(q_ids), -1)
                full = np.frombuffer(block["full"], "u1")
                kth = [(int(s), int(v)) if f else None for f, s, v in zip(
                    full, np.frombuffer(block["kth_s"], "<i8"), np.frombuffer(block["kth_v"], "<i8"))]
                out += search(tree, q_ids, qs, kth, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    groups = -(-shards // BLOCKS)
    sent = (blocks.filter(F.octet_length("q_ids") > 0)
            .select("dim", F.col("shard").alias("home"), F.floor(F.col("shard") / BLOCKS).cast("int").alias("part"),
                    "q_ids", "qs", "full", "kth_s", "kth_v",
                    F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")))
    dealt = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    key = ["dim", "shard", "part"]
    others = dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(away, FOUND)
    every_one = blocks.select("found_q", "found_v", "found_s").mapInPandas(unpack, FOUND).unionByName(others)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (every_one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


OP8_SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id as vec_id,
    list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::bigint as score
  from v a join v b on a.vec_id % {EVERY} = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
  from s)
select query_id, rank, vec_id, score from r where rank <= {K}
"""


@register("op8_topk", OP8_SQL)
def op8_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))
