"""N-gram Jaccard join over prefix trees.

1. Every text becomes its set of shingles (64-bit hashes); texts of equal sets are one class.
2. Document frequencies: distinct texts are dealt over chunks by their hash. A chunk sends its
   distinct shingles, with their counts, as packed 32-bit fingerprints to the range of the hash
   space they belong to; a range adds up and sends one byte a shingle back to each chunk (exact
   up to 127, then eight steps per power of two). Frequent shingles travel once a chunk. Copies
   and fingerprints that meet by chance only raise a frequency.
3. Shingles have one global order, by frequency and hash. In a linked pair each set holds at
   least threshold percent of its own shingles in common with the other, so a set with fewer shingles that
   occur again is out, and the first common shingle stands in both prefixes (n - ceil(t*n) + 1
   shingles, rarest first). Sets that share a prefix shingle are joined to candidate groups by
   connected components; links never leave a group.
4. In a group the sets, ordered by the most frequent shingle first, are stored in a
   path-compressed prefix tree. A set runs through the tree level by level: partial overlaps are
   added up once per shared path, and subtrees are cut where the overlap so far plus what both
   sides have left cannot reach the threshold, or no size in the subtree can. Sets already
   reached leave the tree, so a group yields a spanning forest of its links, not all pairs.
5. A group of more than ``GROUP`` shingles first meets its pivot (one linear pass). Sets linked
   with it are one component by then; only pairs with a set that is not linked with the pivot
   remain, and are dealt over pairs of blocks.

Connected components of the links name each document. Links are judged on the whole sets.

Defined results: null, empty and blank texts have 0 shingles and link with nothing; texts are
taken whole, whatever their length; repeated rows are copies of one another; a row with a null
id takes part but names no component (one of such rows only is null); equal sets link at any
threshold; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credline.llm.common import register, stored, table, with_python
from credline.llm.neardup import components, shingle_set

THRESHOLD = 80  # hundredths
SHINGLE = 5
CHUNK_BYTES = 8_000_000
GROUP = 2_000_000

_U = np.uint64
SETS = "chunk int, digest binary, n long, tokens binary, prefix array<long>"


def class_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, digest (of the set; null for the empty one)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t, SHINGLE) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_python(rows).mapInArrow(run, "doc_id long, n long, digest binary")


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _deal(chunks: int):
    """mapInArrow function over texts: chunk, text. A task sends each text once."""

    def run(batches):
        seen = set()
        for batch in batches:
            keys = [None if t is None else xxhash.xxh3_128_intdigest(t) for t in batch.column(0).to_pylist()]
            keep = []
            for i, k in enumerate(keys):
                if k is not None and k not in seen:
                    seen.add(k)
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] % chunks for i in keep], pa.int32()),
                                              batch.column(0).take(pa.array(keep, pa.int64()))], names=["chunk", "text"])
    return run


def _chunk_sets(texts: pa.ChunkedArray) -> tuple[list[bytes], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Digests and sets of the distinct non-empty sets of a chunk; its distinct tokens (ascending),
    the place of each token among them, and their counts. The same whatever the order of texts."""
    own = {}
    for t in texts.to_pylist():
        s = shingle_set(t, SHINGLE)
        if len(s):
            own.setdefault(_digest(s), s)
    digests = sorted(own)
    sets = [own[d] for d in digests]
    flat = np.concatenate(sets) if sets else np.empty(0, _U)
    return digests, sets, *np.unique(flat, return_inverse=True, return_counts=True)


def _placed(tokens: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of each token (ascending like the tokens) and its 32-bit place inside the range."""
    n, half = _U(ranges), _U(32)
    low = (tokens & _U(0xFFFFFFFF)) * n
    r = ((tokens >> half) * n + (low >> half)) >> half
    return r.astype(np.int64), ((tokens * n) >> half).astype(np.uint32)


def _send_counts(ranges: int):
    def run(rows: pa.Table) -> pa.Table:
        chunk = rows.column("chunk")[0].as_py()
        _, _, tokens, _, counts = _chunk_sets(rows.column("text"))
        r, place = _placed(tokens, ranges)
        starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.empty(0, np.int64)
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(r)]):
            step = np.diff(place[a:b], prepend=np.uint32(0))  # ascending, so small steps: high halves compress away
            out.append((int(r[a]), chunk, (step & 0xFFFF).astype("<u2").tobytes(), (step >> 16).astype("<u2").tobytes(),
                        np.minimum(counts[a:b], 65_535).astype("<u2").tobytes()))
        cols = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                        names=["r", "chunk", "low", "high", "counts"])
    return run


def codes(df: np.ndarray) -> np.ndarray:
    """Document frequencies as bytes, in the same order."""
    wide = 127 + np.floor(8 * np.log2(np.maximum(df, 128) / 128)) + 1
    return np.where(df < 128, df, np.minimum(wide, 255)).astype(np.uint8)


def _add_counts(rows: pa.Table) -> pa.Table:
    """One range: the frequency byte of every token of every chunk."""
    read = lambda c: [np.frombuffer(x, "<u2") for x in rows.column(c).to_pylist()]
    low, high, counts = read("low"), read("high"), read("counts")
    place = np.concatenate([np.cumsum(a.astype(np.uint32) + (b.astype(np.uint32) << np.uint32(16)), dtype=np.uint32)
                            for a, b in zip(low, high)])
    _, at = np.unique(place, return_inverse=True)
    df = codes(np.bincount(at, weights=np.concatenate(counts)).astype(np.int64))[at]
    ends = np.cumsum([len(x) for x in low])
    return pa.table([rows.column("chunk"), rows.column("r"),
                     pa.array([x.tobytes() for x in np.split(df, ends[:-1])], pa.binary())], names=["chunk", "r", "codes"])


def _surviving(threshold: int):
    """Cogroup function: a chunk's texts and frequency bytes -> the sets that may link."""

    def run(texts: pa.Table, counted: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows:
            chunk = texts.column("chunk")[0].as_py()
            digests, sets, _, at, _ = _chunk_sets(texts.column("text"))
            order = np.argsort(counted.column("r").to_numpy())
            parts = counted.column("codes").to_pylist()
            code = np.frombuffer(b"".join(parts[i] for i in order), np.uint8)
            first = 0
            for digest, s in zip(digests, sets):
                n = len(s)
                own = code[at[first:first + n]]
                first += n
                if 100 * np.count_nonzero(own > 1) < threshold * n:
                    continue
                p = n - -(-threshold * n // 100) + 1
                order = np.lexsort((s, own))[:p]
                out.append((chunk, digest, n, s.tobytes(), s[order[own[order] > 1]].astype(np.int64)))
        cols = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())))],
                        names=["chunk", "digest", "n", "tokens", "prefix"])
    return run


class PrefixTree:
    """Sets in a path-compressed tree, the tokens of most sets first; nodes in level order, so that
    the children of a node are consecutive."""

    def __init__(self, sets: list[np.ndarray], threshold: int):
        self.t = threshold
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(times))
        shared = times[at] > 1  # a token of one set is in no overlap
        at, owner = rank[at[shared]], owner[shared]
        order = np.lexsort((at, owner))
        self.sets = np.split(at[order], np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])
        self.mark = np.zeros(len(times), bool)
        self._build()

    def _build(self) -> None:
        sets = self.sets
        keys = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        # stack of open nodes: [from depth, to depth, set that spells it, children, sets that end here]
        root = [0, 0, order[0], [], []]
        stack = [root]
        for prev, i in zip([None, *order[:-1]], order):
            common = 0
            if prev is not None:
                a, b = sets[prev], sets[i]
                m = min(len(a), len(b))
                differ = np.flatnonzero(a[:m] != b[:m])
                common = int(differ[0]) if len(differ) else m
            while stack[-1][0] >= common and len(stack) > 1:
                stack.pop()
            top = stack[-1]
            if top[1] > common:  # split the node at the common depth
                rest = [common, top[1], top[2], top[3], top[4]]
                top[1], top[3], top[4] = common, [rest], []
            if len(sets[i]) > common:
                node = [common, len(sets[i]), i, [], [i]]
                top[3].append(node)
                stack.append(node)
            else:
                top[4].append(i)
        level, nodes, parent = [root], [], [-1]
        for node in level:  # grows while it is read: level order
            nodes.append(node)
            parent += [len(nodes) - 1] * len(node[3])
            level += node[3]
        n = len(nodes)
        self.parent = np.array(parent, np.int64)
        kids = np.array([len(x[3]) for x in nodes], np.int64)
        self.child = 1 + np.cumsum(kids) - kids
        self.kids = kids
        self.depth = np.array([x[1] for x in nodes], np.int64)
        lens = np.array([x[1] - x[0] for x in nodes], np.int64)
        self.seg = np.cumsum(lens) - lens
        self.lens = lens
        self.flat = np.concatenate([sets[x[2]][x[0]:x[1]] for x in nodes] or [np.empty(0, np.int64)])
        self.last = np.array([sets[x[2]][x[1] - 1] if x[1] else -1 for x in nodes], np.int64)
        self.ending = [x[4] for x in nodes]
        self.home = np.empty(len(sets), np.int64)
        least, most, longest = np.full(n, 1 << 60), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.alive = np.zeros(n, np.int64)
        for u in range(n - 1, -1, -1):
            for i in nodes[u][4]:
                self.home[i] = u
                least[u], most[u] = min(least[u], self.size[i]), max(most[u], self.size[i])
                longest[u] = max(longest[u], len(sets[i]))
                self.alive[u] += 1
            p = parent[u]
            if p >= 0:
                least[p], most[p], longest[p] = min(least[p], least[u]), max(most[p], most[u]), max(longest[p], longest[u])
                self.alive[p] += self.alive[u]
        self.least, self.most, self.longest = least, most, longest
        self.here = np.ones(len(sets), bool)

    def remove(self, i: int) -> None:
        self.here[i] = False
        u = int(self.home[i])
        while u >= 0:
            self.alive[u] -= 1
            u = int(self.parent[u])

    def linked(self, i: int) -> list[int]:
        """The sets still in the tree that are linked with set ``i``."""
        own, n, t = self.sets[i], int(self.size[i]), self.t
        self.mark[own] = True
        out = []
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)  # from the root
        while len(nodes):
            need = t * (n + self.least[nodes])  # least possible: overlap * (100 + t) must reach it
            begun = self.depth[nodes] - self.lens[nodes]
            keep = ((self.alive[nodes] > 0) & (t * self.least[nodes] <= 100 * n) & (100 * self.most[nodes] >= t * n)
                    & ((100 + t) * (overlap + np.minimum(len(own), self.longest[nodes] - begun)) >= need))
            nodes, overlap, need = nodes[keep], overlap[keep], need[keep]
            if not len(nodes):
                break
            lens = self.lens[nodes]
            ends = np.cumsum(lens)
            at = np.arange(ends[-1]) + np.repeat(self.seg[nodes] - (ends - lens), lens)
            hit = np.concatenate(([0], np.cumsum(self.mark[self.flat[at]])))
            overlap = overlap + hit[ends] - hit[ends - lens]
            left = len(own) - np.searchsorted(own, self.last[nodes], side="right")
            keep = (100 + t) * (overlap + np.minimum(left, self.longest[nodes] - self.depth[nodes])) >= need
            nodes, overlap = nodes[keep], overlap[keep]
            for u, o in zip(nodes.tolist(), overlap.tolist()):
                out += [j for j in self.ending[u] if self.here[j] and (100 + t) * o >= t * (n + int(self.size[j]))]
            kids = self.kids[nodes]
            ends = np.cumsum(kids)
            overlap = np.repeat(overlap, kids)
            nodes = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.child[nodes] - (ends - kids), kids)
        self.mark[own] = False
        return [j for j in out if j != i]


def link_forest(sets: list[np.ndarray], threshold: int, joined: list[int] = ()) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links 100 * intersection >= threshold * union, breadth first;
    the sets ``joined`` count as one component already."""
    tree = PrefixTree(sets, threshold)
    queue = list(joined)
    for i in queue:
        tree.remove(i)
    for start in (None, *range(len(sets))):
        if start is not None:
            if not tree.here[start]:
                continue
            tree.remove(start)
            queue = [start]
        while queue and tree.alive[0]:
            u = queue.pop()
            for v in tree.linked(u):
                tree.remove(v)
                yield u, v
                queue.append(v)


def _whole_groups(batches) -> Iterator[pa.Table]:
    """The rows of one value of the first column at a time; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        g = batch.column(0).to_pylist()
        start = 0
        for i in range(1, len(g) + 1):
            if i == len(g) or g[i] != g[start]:
                if held and held[-1].column(0)[0].as_py() != g[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield pa.Table.from_batches(held)


def _links(threshold: int):
    """mapInArrow function over (g, digest, tokens, joined) sorted by g: the links that span each group."""

    def run(batches):
        for rows in _whole_groups(batches):
            digest = rows.column("digest").to_pylist()
            sets = [np.frombuffer(x, _U) for x in rows.column("tokens").to_pylist()]
            joined = [i for i, x in enumerate(rows.column("joined").to_pylist()) if x]
            found = list(link_forest(sets, threshold, joined))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([digest[x[i]] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])
    return run


def _to_pivot(threshold: int):
    """mapInArrow function: adds whether a set is linked with its group's pivot."""

    def run(batches):
        for batch in batches:
            joined, pivot, own = [], None, None
            names = batch.schema.names
            for p, x in zip(batch.column(names.index("pivot")).to_pylist(), batch.column(names.index("tokens")).to_pylist()):
                if p != pivot:
                    pivot, own = p, np.frombuffer(p, _U)
                s = np.frombuffer(x, _U)
                both = len(np.intersect1d(own, s, assume_unique=True))
                joined.append(100 * both >= threshold * (len(own) + len(s) - both))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in ("root", "digest", "tokens", "total")),
                                              pa.array(joined)], names=["root", "digest", "tokens", "total", "joined"])
    return run


def _large_links(large: DataFrame, threshold: int) -> DataFrame:
    """Links that span groups of more than ``GROUP`` tokens (root, digest, tokens, total)."""
    pivots = large.filter("root = digest").select("root", F.col("tokens").alias("pivot"))  # one row a large group
    met = stored(large.join(pivots, "root").mapInArrow(
        _to_pivot(threshold), "root binary, digest binary, tokens binary, total long, joined boolean"), "pivoted")
    star = met.filter("joined and root <> digest").select(F.col("root").alias("a"), F.col("digest").alias("b"))
    size = F.octet_length("tokens") / 8
    blocks = met.groupBy("root").agg(F.ceil(F.sum(F.when(F.col("joined"), size)) / GROUP).cast("int").alias("ns"),
                                     F.ceil(F.sum(F.when(~F.col("joined"), size)) / GROUP).cast("int").alias("nu"))
    rows = met.join(blocks.filter("nu > 0"), "root")
    h = F.xxhash64("digest")
    rows = rows.withColumn("i", F.when(F.col("joined"), F.pmod(h, F.col("ns"))).otherwise(F.pmod(h, F.col("nu"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("nu") - 1)
    # a joined block meets every block of the others; a block of the others meets all blocks
    joined = rows.filter("joined").select("root", "digest", "tokens", "joined", F.explode(F.transform(
        others, lambda u: F.struct(u.alias("u"), F.col("i").alias("v"), F.lit(True).alias("s")))).alias("p"))
    rest = rows.filter("not joined").select("root", "digest", "tokens", "joined", F.explode(F.concat(
        F.transform(others, lambda u: F.struct(F.least(u, F.col("i")).alias("u"), F.greatest(u, F.col("i")).alias("v"), F.lit(False).alias("s"))),
        F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda v: F.struct(F.col("i").alias("u"), v.alias("v"), F.lit(True).alias("s"))))).alias("p"))
    dealt = joined.unionByName(rest).select(F.sha2(F.concat_ws(",", F.hex("root"), "p.u", "p.v", F.col("p.s").cast("string")), 256).alias("g"),
                                            "digest", "tokens", "joined")
    return star.unionByName(_spanned(dealt, "g", threshold))


def _spanned(rows: DataFrame, group: str, threshold: int) -> DataFrame:
    return (rows.select(F.col(group).alias("g"), "digest", "tokens", "joined").repartition("g").sortWithinPartitions("g", "digest")
            .mapInArrow(_links(threshold), "a binary, b binary"))


def links(docs: DataFrame, text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """a, b (digests of sets): links between different sets that connect all that are linked."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // CHUNK_BYTES))
    dealt = with_python(texts).mapInArrow(_deal(parts), "chunk int, text string")
    sent = dealt.groupBy("chunk").applyInArrow(_send_counts(parts), "r int, chunk int, low binary, high binary, counts binary")
    counted = sent.groupBy("r").applyInArrow(_add_counts, "chunk int, r int, codes binary")
    sets = stored(dealt.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_surviving(threshold), SETS), "ngram-sets")

    posts = sets.select("digest", F.explode("prefix").alias("token"))
    lowest = posts.groupBy("token").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).filter("a <> z").select("token", "a")
    groups = components(posts.join(lowest, "token").select("a", F.col("digest").alias("b")))  # node, root
    one = sets.groupBy("digest").agg(F.min("chunk").alias("chunk"), F.min("n").alias("n"))  # equal sets of several texts
    members = one.join(groups.withColumnRenamed("node", "digest"), "digest")
    members = stored(members.join(members.groupBy("root").agg(F.sum("n").alias("total")), "root"), "ngram-groups")
    rows = sets.select("digest", "chunk", "tokens").join(members, ["digest", "chunk"]).select("root", "digest", "tokens", "total")
    small = _spanned(rows.filter(F.col("total") <= GROUP).withColumn("joined", F.lit(False)), "root", threshold)
    large = rows.filter(F.col("total") > GROUP)
    if members.filter(F.col("total") > GROUP).isEmpty():
        return small
    return small.unionByName(_large_links(large, threshold))


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    rows = stored(class_rows(docs, id_col, text_col), "ngram-rows")
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("m"))
    roots = stored(components(links(docs, text_col, threshold)).withColumnRenamed("node", "digest"), "ngram-roots")
    joined = classes.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    named = joined.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("m").alias("m")).filter("m > 1")
    named = joined.select("digest", "root").join(named.select("root", "component_id"), "root").select(
        "digest", "component_id", F.lit(True).alias("named"))
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


@register("op11_ngramjoin")
def op11_ngramjoin(spark, sf_dir):
    return linked_components(table(spark, sf_dir, "documents"))
