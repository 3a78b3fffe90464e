"""Near-duplicates by b-bit MinHash.

1. Each text becomes its set of ``SHINGLE``-word shingles (64-bit hashes) and ``BANDS`` x
   ``ROWS`` minima. Band keys are hashes of ``ROWS`` whole minima; of every minimum only the low
   ``BITS`` bits are kept, packed into the signature. Texts with equal sets (128-bit digest)
   become one node, so a large group of copies is one row from here on.
2. Nodes that share a band key are candidates. Two signatures that agree in a share m of their
   places have an estimated similarity (m - c) / (1 - c), c = 2**-BITS being the chance of an
   accidental agreement; m comes from bit counts of the packed words. Pairs estimated below
   ``threshold - MARGIN`` (four standard deviations) are dropped. A bucket hands on a spanning
   forest of its remaining pairs, found breadth first against the nodes not yet reached, never
   all pairs; a bucket of more than ``BUCKET`` nodes is dealt over all pairs of its blocks.
3. Connected components of these forests hold every link. Within each, links are confirmed on
   the full shingle sets, again breadth first; a component with more than ``GROUP`` shingles is
   dealt over pairs of blocks. The confirmed forests' connected components are the result.

Bands of 4 in 32 miss a pair of similarity 0.75 with probability 5e-6. Components come from
alternating large-star and small-star steps, each written to the shared folder; only counts
reach the driver. Everything hot is either one row (equal sets), salted (the way back to the
copies) or dealt by blocks.

Defined results: null, empty and blank texts have the empty set, 0 shingles, and link with
nothing; repeated rows are copies of one another; a row with a null id takes part, but gives
no name to its component (a component of such rows only is null); kept is doc_id = component_id,
nulls being equal; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credline.llm.common import free_name, partition_id, register, row_key, stored, table, with_python

SHINGLE = 5
THRESHOLD = 75  # hundredths
BANDS, ROWS, BITS = 32, 4, 4
MARGIN = 0.16
BUCKET = 2048
GROUP = 2_000_000
SALT = 16

SETS = "rid long, doc_id long, k long, n long, digest binary, keys array<long>, sig binary"
_SETS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("n", pa.int64()),
                   ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # a well-known 64-bit mixer's constants
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. bytes.lower and bytes.split know
    A-Z and the six ASCII blanks only."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, ws), np.uint64, len(ws))
    n = min(size, len(ws))
    out = np.full(len(ws) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i:i + len(out)]) * _STEP
        out ^= out >> np.uint64(29)
    return np.unique(_mix(out))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (int64, a row per non-empty set) and packed signatures (uint64)."""
    lengths = [len(s) for s in sets]
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    minima = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for i in range(BANDS * ROWS):
        minima[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], starts)
    wide = minima.astype(np.uint64).reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), wide.shape[:2])
    for r in range(ROWS):
        keys = _mix(keys * _STEP + wide[:, :, r])
    low = (_mix(minima.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(-1, BANDS * ROWS * BITS // 64, 64 // BITS)
    sig = np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)
    return keys.astype(np.int64), sig


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (last axis: words)."""
    x = a ^ b
    for s in (1, 2) if BITS == 4 else range(1, BITS):
        x = x | (x >> np.uint64(s))
    ones = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    differ = np.bitwise_count(x & ones).sum(axis=-1)
    c = 2.0**-BITS
    return (1 - differ / (BANDS * ROWS) - c) / (1 - c)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Set size, set digest, band keys and signature of each row."""

    def run(batches):
        rid = partition_id() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t) for t in part.column(2).to_pylist()]
                full = [s for s in sets if len(s)]
                keys, sigs = signatures(full) if full else (None, None)
                keys, sigs = iter(keys if full else ()), iter(sigs if full else ())
                rows = [(next(keys), next(sigs).tobytes()) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(rid, rid + len(sets))), part.column(0), part.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([k for k, _ in rows], pa.list_(pa.int64())), pa.array([s for _, s in rows], pa.binary())], schema=_SETS)
                rid += len(sets)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("k"),
                       F.col(text_col).cast("string").alias("text"))
    return with_python(rows).mapInArrow(run, SETS)


def forest(n: int, near) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest over 0..n-1, breadth first: ``near(u, rest)`` tells which of
    the nodes ``rest`` (ascending, not yet reached) are linked to u."""
    rest = np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            hit = near(u, rest)
            for v in rest[hit].tolist():
                yield u, v
                queue.append(v)
            rest = rest[~hit]


def _grouped(batches) -> Iterator[pa.Table]:
    """The rows of one value of the first column at a time; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(g[1:] != g[:-1]) + 1
        if held and held[-1].column(0)[0].as_py() != g[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(g)]):
            held.append(batch.slice(a, b - a))
            if b < len(g):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], names=["a", "b"])


def _bucket_forests(least: float):
    """mapInArrow function over (g, node, sig) sorted by g: forest edges of each group."""
    words = BANDS * ROWS * BITS // 64

    def whole_groups(batches):
        """Batches that end with a group's last row."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(g[1:] != g[:-1])
            if held and held[-1].column(0)[held[-1].num_rows - 1].as_py() != g[0]:
                yield pa.Table.from_batches(held)
                held = []
            if len(cut):
                yield pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]) + 1)])
                held = [batch.slice(int(cut[-1]) + 1)]
            else:
                held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for rows in whole_groups(batches):
            g = rows.column(0).to_numpy()
            node = rows.column(1).to_numpy()
            sig = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint64).reshape(-1, words)
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(g)])))
            two = starts[sizes == 2]
            two = two[agreement(sig[two], sig[two + 1]) >= least]
            a, b = [node[two]], [node[two + 1]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = sig[s:s + n]
                found = list(forest(n, lambda u, rest, own=own: agreement(own[u], own[rest]) >= least))
                if found:
                    u, v = np.array(found).T
                    a.append(node[s + u])
                    b.append(node[s + v])
            yield _edges(np.concatenate(a), np.concatenate(b))
    return run


def exact_forest(sets: list[np.ndarray], threshold: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links 100 * intersection >= threshold * union."""
    size = np.array([len(s) for s in sets])
    _, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = times[ids] > 1  # a shingle of one set only cannot be in an intersection
    ids, owner = ids[shared], owner[shared]
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    mark = np.zeros(len(times), bool)
    state = {"n": len(sets), "ids": ids, "owner": owner}

    def near(u, rest):
        if 2 * len(rest) < state["n"]:  # look at the sets not yet reached only
            alive = np.zeros(len(sets), bool)
            alive[rest] = True
            keep = alive[state["owner"]]
            state.update(n=len(rest), ids=state["ids"][keep], owner=state["owner"][keep])
        own = ids[first[u]:first[u + 1]]
        mark[own] = True
        both = np.bincount(state["owner"][mark[state["ids"]]], minlength=len(sets))[rest]
        mark[own] = False
        return 100 * both >= threshold * (size[u] + size[rest] - both)
    return forest(len(sets), near)


def _confirm(threshold: int):
    """mapInArrow function over (g, node, text) sorted by g: confirmed forest edges."""

    def run(batches):
        for rows in _grouped(batches):
            node = rows.column(1).to_numpy()
            sets = [shingle_set(t) for t in rows.column(2).to_pylist()]
            found = list(exact_forest(sets, threshold))
            if found:
                u, v = np.array(found).T
                yield _edges(node[u], node[v])
    return run


def _dealt(rows: DataFrame, key: str, blocks, *keep: str) -> DataFrame:
    """g (hash of key and blocks), keep: a key with one block is one group, a key with more
    meets in a group for every pair of its blocks."""
    nb = rows.withColumn("nb", blocks).withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pairs = nb.withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("nb") - 1).cast("int"))))
    g = F.xxhash64(key, F.least("i", "j"), F.greatest("i", "j"))
    return pairs.select(g.alias("g"), *keep)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges (a, b)."""
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("s")
    before = e.agg(*state).first()
    while before["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = e.agg(*state).first()
        if after == before:
            break
        before = after
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: int = THRESHOLD) -> DataFrame:
    """rid, doc_id, k (hash of id and text), component (an internal number), n_shingles,
    component_id, kept: one row per row of ``docs``; rid tells repeated rows apart."""
    rows = stored(sketch(docs, id_col, text_col), "minhash")
    classes = stored(rows.filter("n > 0").groupBy("digest").agg(
        F.min("rid").alias("node"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("m")), "minhash-classes")
    nodes = rows.join(classes.select(F.col("node").alias("rid")), "rid", "left_semi").select(
        F.col("rid").alias("node"), "k", "n", "keys", "sig")
    bands = nodes.select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = bands.join(shared, "key").join(nodes.select("node", "sig"), "node")
    least = threshold / 100 - MARGIN
    grouped = _dealt(members, "key", F.ceil(F.col("m") / BUCKET), "node", "sig")
    near = with_python(grouped).repartition("g").sortWithinPartitions("g", "node").mapInArrow(_bucket_forests(least), "a long, b long")
    maybe = stored(components(near), "minhash-candidates")

    sizes = maybe.join(nodes.select("node", "n", "k"), "node")
    total = sizes.groupBy("root").agg(F.sum("n").alias("total"))
    chosen = stored(sizes.join(total, "root").select("root", "node", "k", "total"), "minhash-groups")
    texts = (docs.select(row_key(id_col, text_col).alias("k"),
                         F.col(text_col).cast("string").alias("text"))
             .join(chosen.hint("merge"), "k"))  # the same plan at every size
    grouped = _dealt(texts, "root", F.ceil(F.col("total") / GROUP), "node", "text")
    links = grouped.repartition("g").sortWithinPartitions("g", "node").mapInArrow(_confirm(threshold), "a long, b long")
    roots = components(links)

    joined = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    name = joined.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("m").alias("m"))
    named = joined.select("digest", "root").join(name.filter("m > 1").select("root", "component_id"), "root").select(
        "digest", "root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    out = (rows.select("rid", "doc_id", "k", "n", "digest", F.pmod(F.xxhash64("rid"), F.lit(SALT)).cast("int").alias("salt"))
           .join(named.withColumn("named", F.lit(True)), ["digest", "salt"], "left"))
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("rid", "doc_id", "k", F.coalesce("root", "rid").alias("component"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component: of the rows that name it the first. Rows
    without words link with nothing and all stay."""
    # written once: read five times below, each a copy of the joins in the driver's plan otherwise
    found = stored(near_duplicates(docs, id_col, text_col, threshold).filter("kept").select("rid", "k", "component", "n_shingles"), "minhash-kept")
    named = found.filter("n_shingles > 0")
    stay = named.join(named.groupBy("component").agg(F.min("rid").alias("rid")), "rid", "left_semi").select("k")
    key = free_name(docs, "k")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    stay = stored(stay.withColumnRenamed("k", key), "minhash-stay")
    wordless = found.filter("n_shingles = 0").select(F.col("k").alias(key)).distinct()
    repeated = named.groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("k").alias(key))
    single = keyed.join(stay.join(repeated, key, "left_anti").unionByName(wordless), key, "left_semi")
    twice = keyed.join(stay.join(repeated, key, "left_semi"), key, "left_semi").dropDuplicates([key])
    return single.unionByName(twice).select(*docs.columns)


@register("op10_neardup")
def op10_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
