"""Conversation prefix trie by ternary search trees per range shard.

1. Distinct turns (role, text) get dictionary ids in their order, so a conversation becomes an
   array of ids (with the byte lengths of the texts), in the order of turn, null first. Turns of
   equal number stand in the order of role and text.
2. Conversations are rebuilt: the first h turns of the conversation that opens their group, then
   their own turns after the first h.
3. Conversations with equal turns meet once, sorted by id: their number, their smallest id and
   the hash of their ids come out of one streaming pass, which holds one conversation at a time.
4. The distinct sequences are range-partitioned in their order. Each shard inserts its own into
   a ternary search tree, medians first, which keeps the trees of siblings balanced. Nodes are
   numbered as they are made, children after their parents, so one pass backwards over the
   numbers sums up members, leaves and savings without recursion.
5. A node that a neighbouring shard shares lies on the shard's first or last sequence, down to
   the common prefix of the two sequences at the border (one small row per shard). Such boundary
   nodes leave the shard as partial sums under a digest of their prefix and are merged;
   everything else is final in its shard. A node's text counts as kept in the first shard that
   has it, so that all sums over shards are plain sums.

A sequence is one row (16 bytes a turn) and lives in one shard; a shard holds about
``SHARD_TURNS`` turns. One SHA-256 runs over all ids that end in a node, as the result asks for:
ids of a hot sequence pass through one task, in Arrow batches.

Defined results: a null role or text counts as empty; rows with a null conversation id take no
part; repeated rows are turns of their own; ``c % 5`` has the sign of c; a conversation without
turns ends in the root; texts are compared whole, whatever their length; other columns are
ignored; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credline.llm.common import register, stored, table, with_python
from credline.operators.common import global_index

SHARD_TURNS = 100_000
GROUP, MOST_SHARED = 5, 8
NOTHING = hashlib.sha256(b"").hexdigest()

PATH = "array<struct<id:long,size:long>>"
NODES = ("key binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string")
_NODES = pa.schema([("key", pa.binary()), ("above", pa.binary()), *((c, pa.int64()) for c in (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())])


def sequences(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, path: each conversation's turns as dictionary ids with the lengths of their texts."""
    empty = F.lit("")
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text"))
    rows = rows.withColumn("d", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    words = global_index(rows.select("d", "role", "text").dropDuplicates(["d"]), ["role", "text"], "id")
    known = words.select("d", "id", F.octet_length("text").cast("long").alias("size"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id", "size")
    return (rows.select("conv_id", "turn", "d").join(known, "d").groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(turn)).alias("ts"))
            .select("conv_id", F.transform("ts", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("path")))


def rebuilt(seqs: DataFrame, group: int = GROUP, most: int = MOST_SHARED) -> DataFrame:
    """conv_id, path: the first h turns of conversation c - c % group, then c's own after its first h;
    h = crc32(decimal c) % (most + 1)."""
    c = F.col("conv_id")
    seqs = seqs.withColumns({"h": F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most + 1)).cast("int"),
                             "opens": c - c % group})
    heads = seqs.filter(c == F.col("opens")).select("opens", F.slice("path", 1, most).alias("head"))
    first = F.slice(F.coalesce("head", F.array().cast(PATH)), F.lit(1), F.col("h"))
    own = F.slice("path", F.col("h") + 1, F.size("path") + 1)
    return seqs.join(heads, "opens", "left").select("conv_id", F.concat(first, own).alias("path"))


def _ends(batches) -> Iterator[pa.RecordBatch]:
    """One row per distinct path from (pkey, conv_id, path) sorted by the first two."""
    key, path, low, n, sha = None, None, 0, 0, None
    kind = None
    for batch in batches:
        kind = batch.schema.field("path").type
        ids = batch.column(1).to_pylist()
        for i, k in enumerate(batch.column(0).to_pylist()):
            if k != key:
                if key is not None:
                    yield _end(path, low, n, sha, kind)
                key, path, low, n, sha = k, batch.column(2).slice(i, 1), ids[i], 1, hashlib.sha256(str(ids[i]).encode())
            else:
                n += 1
                sha.update(b",%d" % ids[i])
    if key is not None:
        yield _end(path, low, n, sha, kind)


def _end(path, low, n, sha, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([path.cast(kind), pa.array([low], pa.int64()), pa.array([n], pa.int64()),
                                       pa.array([sha.hexdigest()])], names=["path", "low", "n", "ends"])


def distinct_paths(convs: DataFrame) -> DataFrame:
    """path, low, n, ends: the distinct sequences with the conversations that have them."""
    keyed = convs.select(F.sha2(F.array_join(F.transform("path", lambda t: t["id"].cast("string")), ","), 256).alias("pkey"),
                         "conv_id", "path")
    return with_python(keyed).repartition("pkey").sortWithinPartitions("pkey", "conv_id").mapInArrow(
        _ends, f"path {PATH}, low long, n long, ends string")


class Tree:
    """A ternary search tree over id sequences. Node 0 is the root of the trie; a node's lower and
    higher siblings hang on ``less`` and ``more``, its smallest-depth child on ``down``."""

    def __init__(self):
        self.key, self.less, self.more, self.down = [0], [0], [0], [0]
        self.parent, self.depth, self.size = [-1], [0], [0]

    def _make(self, key: int, size: int, parent: int) -> int:
        for column, value in ((self.key, key), (self.less, 0), (self.more, 0), (self.down, 0), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1), (self.size, size)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, path: list[int], sizes: list[int]) -> int:
        """The node in which the sequence ends."""
        key, less, more, down = self.key, self.less, self.more, self.down
        at = 0
        for x, size in zip(path, sizes):
            above, at = at, down[at]
            if not at:
                at = down[above] = self._make(x, size, above)
                continue
            while key[at] != x:
                side = less if x < key[at] else more
                if not side[at]:
                    side[at] = self._make(x, size, above)
                at = side[at]
        return at


def medians(n: int) -> Iterator[int]:
    """0..n-1, the middle first, then the middles of both halves, and so on."""
    spans = [(0, n)]
    while spans:
        a, b = spans.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            spans += [(a, mid), (mid + 1, b)]


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays; 0 where one is null."""
    least = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), least), F.slice(b, F.lit(1), least), lambda x, y: x == y)
    at = F.array_position(same, False)
    return F.when(a.isNull() | b.isNull(), F.lit(-1)).when(at > 0, at - 1).otherwise(least).cast("int")


def shard_nodes(rows: pa.Table) -> pa.Table:
    """The nodes of one shard (path, low, n, ends, before, after, goes_on). Boundary nodes have a
    key; a node below one has it in ``above``."""
    flat = rows.column("path").combine_chunks()
    at = flat.offsets.to_numpy()
    ids, sizes = (flat.values.field(f).to_pylist() for f in ("id", "size"))
    paths = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
    lens = [sizes[a:b] for a, b in zip(at[:-1], at[1:])]
    order = sorted(range(len(paths)), key=paths.__getitem__)
    before, after, goes_on = (rows.column(c)[0].as_py() for c in ("before", "after", "goes_on"))
    low, n, ends = (rows.column(c).to_pylist() for c in ("low", "n", "ends"))

    tree, end_of = Tree(), {}
    for i in medians(len(order)):
        end_of[tree.insert(paths[order[i]], lens[order[i]])] = order[i]
    size = len(tree.key)
    members, least, kids, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    last = order[-1]
    keys: dict[int, bytes] = {}
    seen: set[int] = set()  # nodes of an earlier shard
    for path, depth, early in ((paths[order[0]], before, True), (paths[last], after, False)):
        node, digest = 0, hashlib.blake2b(digest_size=16)
        for d in range(depth + 1):  # a shard without that neighbour has depth -1
            if d:
                node = _child(tree, node, path[d - 1])
                digest.update(path[d - 1].to_bytes(8, "little", signed=True))
            keys[node] = digest.copy().digest()
            if early:
                seen.add(node)
    hashes = [NOTHING] * size
    for u in range(size - 1, -1, -1):
        i = end_of.get(u)
        if i is not None:
            members[u] += n[i]
            least[u] = low[i] if least[u] is None else min(least[u], low[i])
            hashes[u] = ends[i]
        if not tree.down[u] and not (i == last and goes_on):
            leaves[u] = 1
        new = u not in seen
        saved[u] += (members[u] - new) * tree.size[u]
        p = tree.parent[u]
        if p >= 0:
            members[p] += members[u]
            least[p] = least[u] if least[p] is None else min(least[p], least[u])
            kids[p] += new
            leaves[p] += leaves[u]
            saved[p] += saved[u]
    above = [keys.get(p) for p in tree.parent]
    parent = [least[p] if p >= 0 else None for p in tree.parent]
    return pa.Table.from_arrays([
        pa.array([keys.get(u) for u in range(size)], pa.binary()), pa.array(above, pa.binary()),
        *(pa.array(x, pa.int64()) for x in (least, tree.depth, parent, members, kids, leaves, saved)), pa.array(hashes)], schema=_NODES)


def _child(tree: Tree, node: int, key: int) -> int:
    at = tree.down[node]
    while tree.key[at] != key:
        at = tree.less[at] if key < tree.key[at] else tree.more[at]
    return at


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie's nodes over conversations (conv_id, path)."""
    paths = stored(distinct_paths(convs), "conversation-paths")
    total = paths.agg(F.coalesce(F.sum(F.size("path") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_turns))
    ranged = stored(paths.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()), "conversation-shards")
    by_shard = Window.orderBy("shard")  # one row per shard
    ends = ranged.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    ends = ends.withColumns({"left": F.lag("last").over(by_shard), "right": F.lead("first").over(by_shard)})
    after = common_prefix(F.col("last"), F.col("right"))
    ends = ends.select("shard", common_prefix(F.col("left"), F.col("first")).alias("before"), after.alias("after"),
                       (F.col("right").isNotNull() & (after == F.size("last"))).alias("goes_on"))
    nodes = stored(with_python(ranged).join(F.broadcast(ends), "shard").groupBy("shard").applyInArrow(shard_nodes, NODES),
                   "conversation-nodes")
    cols = ["depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    edges = nodes.filter("key is not null").groupBy("key").agg(
        F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in cols[1:5]],
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256"))), F.lit(NOTHING)).alias("ends_sha256"))
    inner = nodes.filter("key is null")
    over = edges.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    below = inner.filter("above is not null").drop("parent_conv_id").unionByName(edges.drop("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", *cols[1:]]
    return inner.filter("above is null").select(*out).unionByName(below.join(over, "above", "left").select(*out))


_CRC = """xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint),
  lambda a, b: list_reduce([xor(a, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0],
    lambda p, q: case when p & 1 = 1 then xor(p >> 1, 3988292384) else p >> 1 end)))"""
OP12_SQL = f"""
with t as (select conv_id, dense_rank() over (order by coalesce(role, ''), coalesce(text, '')) as id, strlen(coalesce(text, '')) as size,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % {GROUP} as opens, {_CRC} % {MOST_SHARED + 1} as h from (select distinct conv_id from t)),
r as (select c.conv_id, 0 as part, t.pos, t.id, t.size from c join t on t.conv_id = c.opens where t.pos <= c.h
  union all select c.conv_id, 1, t.pos, t.id, t.size from c join t using (conv_id) where t.pos > c.h),
s as (select c.conv_id, coalesce(p, []::bigint[]) as p, coalesce(z, []::bigint[]) as z from c left join (
  select conv_id, list(id order by part, pos) as p, list(size order by part, pos) as z from r group by conv_id) using (conv_id)),
n as (select p[1:d] as p, d, any_value(case when d = 0 then 0 else z[d] end)::bigint as size, min(conv_id) as conv_id, count(*) as n_convs,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (len(p) = d) as ends
  from (select conv_id, p, z, unnest(range(0, len(p) + 1)) as d from s) group by p[1:d], d),
k as (select p[1:d - 1] as p, count(*) as n_children from n where d > 0 group by 1),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (p)),
g as (select p[1:a] as p, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * size) as saved
  from (select *, unnest(range(0, d + 1)) as a from m) group by p[1:a])
select m.conv_id, m.d::bigint as depth, u.conv_id as parent_conv_id, m.n_convs::bigint as n_convs, m.n_children::bigint as n_children,
  g.n_leaves::bigint as n_leaves, g.saved::bigint as saved_tokens, sha256(coalesce(m.ends, '')) as ends_sha256
from m join g using (p) left join m u on m.d > 0 and u.p = m.p[1:m.d - 1]
"""


@register("op12_convtrie", OP12_SQL)
def op12_convtrie(spark, sf_dir):
    return trie(rebuilt(sequences(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")))
