"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``WINDOW`` words (an item of fewer words is one window).
A document contains a window only if it contains all its shingles (``SHINGLE`` words), so one
shingle of each window suffices to find every candidate: the prefix of full containment has
length 1 when the shingles are ordered by rarity.

1. The documents' shingles that any window holds are found (the benchmark's shingle hashes are
   broadcast after a check of their number; beyond it the join shuffles) and written once.
2. Their corpus counts order the shingles; each window keeps its rarest one.
3. Occurrences of the kept shingles give candidate places; windows that would begin before the
   first or end after the last word of the text fall out.
4. Places are gathered per text and every one is verified, word by word, in the whole text.

A row is known by a hash of its id and text, so rows may repeat and ids may be null; a wrong
meeting would only add a candidate, which step 4 rejects. A frequent shingle is dealt by its
documents, never gathered.

Defined results: a null text has no words and is clean, a null or wordless item has no window;
an item with a null id still marks words but is not listed; of items with one id each marks,
the id is listed once; repeated rows give equal rows; other columns are ignored; an empty
benchmark leaves every document clean, an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credline.llm.common import free_name, register, row_key, stored, table

WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 2_000_000
# fixed value: everything but digits, a-z and non-ASCII characters separates words
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else changed; texts without other letters take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS, -1), "")


def _shingle(array: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(array, at + i) for i in range(size)])


def windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """w (its words), n, items (ids of the items that hold it): one row per distinct window."""
    rows = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    at = rows.select("item", "ws", F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))).alias("at"))
    return (at.select("item", F.slice("ws", F.col("at") + 1, window).alias("w"))
            .groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("n", F.size("w")))


def _shingles(rows: DataFrame, array: str, size: int, *keep: str) -> DataFrame:
    """``keep``, at, h: the shingles of ``size`` words of the array column."""
    n = F.size(array)
    long = rows.filter(n >= size)
    at = long.select(*keep, array, F.explode(F.sequence(F.lit(0), n - size)).alias("at"))
    return at.select(*keep, "at", _shingle(F.col(array), F.col("at"), size).alias("h"))


def match(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
          shingle: int = SHINGLE, every: bool = True) -> DataFrame:
    """doc_id, k (hash of id and text), n_words, hits (array of start, n: the verified windows),
    item_ids (sorted as strings): one row per document, or per document with a candidate place
    if not ``every``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        row_key(id_col, text_col).alias("k"))
    wins = stored(windows(items, item_id_col, item_text_col, window).withColumn("wid", F.monotonically_increasing_id()), "windows")
    sizes = [r["s"] for r in wins.select(F.least("n", F.lit(shingle)).alias("s")).distinct().collect()]  # at most ``shingle`` values
    wanted, seen = [], []
    for size in sizes:
        own = _shingles(wins.filter(F.least("n", F.lit(shingle)) == size), "w", size, "wid").withColumn("size", F.lit(size))
        wanted.append(own)
        keys = own.select("h").distinct()
        if keys.count() <= BROADCAST_ROWS:
            keys = F.broadcast(keys)
        found = _shingles(texts.select("k", words(F.col("text")).alias("ws")), "ws", size, "k")
        seen.append(found.join(keys, "h", "left_semi").select("k", "at", "h", F.lit(size).alias("size")))
    if not wanted:
        empty = "array<struct<start:int,n:int,w:array<string>,items:array<string>>>"
        cands = texts.select("k").limit(0).withColumn("cands", F.lit(None).cast(empty))
    else:
        occurs = stored(_union(seen), "benchmark-shingles")
        rare = occurs.groupBy("size", "h").agg(F.count(F.lit(1)).alias("df"))
        prefix = (_union(wanted).join(rare, ["size", "h"])  # a window with an unseen shingle occurs nowhere
                  .groupBy("wid").agg(F.min(F.struct("df", "h", "at")).alias("p"), F.count(F.lit(1)).alias("known"))
                  .join(wins, "wid").filter(F.col("known") == F.col("n") - F.least("n", F.lit(shingle)) + 1)
                  .select(F.least("n", F.lit(shingle)).alias("size"), F.col("p.h").alias("h"), F.col("p.at").alias("off"),
                          "w", "n", F.transform("items", lambda i: i.cast("string")).alias("items")))
        cands = (occurs.join(prefix, ["size", "h"]).withColumn("start", F.col("at") - F.col("off")).filter("start >= 0")
                 .groupBy("k").agg(F.collect_set(F.struct("start", "n", "w", "items")).alias("cands")))
    rows = texts.join(cands, "k", "left" if every else "inner").select("doc_id", "k", "cands", words(F.col("text")).alias("ws"))
    held = F.filter(F.col("cands"), lambda c: (c["start"] + c["n"] <= F.size("ws"))
                    & (F.slice(F.col("ws"), c["start"] + 1, c["n"]) == c["w"]))
    rows = rows.select("doc_id", "k", F.size("ws").cast("long").alias("n_words"),
                       F.when(F.col("cands").isNotNull(), held).alias("held"))
    none = F.array().cast("array<struct<start:int,n:int>>")
    return rows.select(
        "doc_id", "k", "n_words",
        F.coalesce(F.array_sort(F.transform("held", lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n")))), none).alias("hits"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("held", lambda c: c["items"])))),
                   F.array().cast("array<string>")).alias("item_ids"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs."""
    hit = match(docs, items, id_col, text_col, every=False, **options).filter(F.size("hits") > 0).select("k").distinct()
    key = free_name(docs, "k")
    return docs.withColumn(key, row_key(id_col, text_col)).join(hit.withColumnRenamed("k", key), key, "left_anti").select(*docs.columns)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def n_covered(hits: Column) -> Column:
    """Words inside any of the sorted (start, n) windows."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, h):
        end = h["start"] + h["n"]
        more = F.greatest(end - F.greatest(acc["end"], h["start"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + more).alias("n"))
    return F.aggregate(hits, zero, step, lambda acc: acc["n"])


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as ws from documents),
i as (select item_id, {_WORDS} as ws from benchmark),
w as (select distinct item_id, ws[pos:pos + {WINDOW - 1}] as w from (
  select item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) as pos from i where len(ws) > 0)),
z as (select distinct len(w) as n from w),
p as (select rid, n, unnest(range(1, len(ws) - n + 2)) as pos, ws from d, z where len(ws) >= n),
h as (select p.rid, p.pos, p.n, w.item_id from p join w on w.w = p.ws[p.pos:p.pos + p.n - 1]),
c as (select rid, count(distinct x)::bigint as n_hit from (select rid, unnest(range(pos, pos + n)) as x from h) group by rid),
s as (select rid, count(*)::bigint as n_items, string_agg(s, ',' order by s) as ids
  from (select distinct rid, item_id::varchar as s from h where item_id is not null) group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (rid) left join s using (rid)
"""


@register("op4_decontaminate", OP4_SQL)
def op4_decontaminate(spark, sf_dir):
    found = match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", n_covered(F.col("hits")).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("hits") > 0).alias("contaminated"))
