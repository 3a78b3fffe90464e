"""Secret scan with corpus-wide ownership frequency.

One pass over the texts finds the base spans (patterns below) and further bare tokens that
look random. Every candidate value is hashed; the hashes are counted over the whole corpus by
distinct repositories and owners. A value that many owners or many repositories hold is a widely
copied example, also where one owner has all of these; a value of one owner and few repositories,
which looks live (long, mixed, high entropy, no placeholder), is an owner-specific credential. Bare tokens of the second kind that no base span touches become
further spans (kind ``owned``); the base spans always stay.

Here ``source`` is the owner and the document the repository; both are parameters. Values are
kept as SHA-256 digests only. Shuffled are (hash, owner, repository) keys, reduced map side, and
candidate positions, salted against a hash that a third of all documents hold; no text moves.

Defined results: a null text is empty and has no spans; a null owner counts as one owner of its
own, not with the empty one; a null id is kept; repeated rows are repositories of their own, unless ``repo_col`` says
otherwise; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credline.llm.common import partition_id, register, stored, table, with_python

# fixed values: the base patterns, kinds in their order, least lengths
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"  # maximal runs, so a least length may stand in the pattern
KINDS = ("assign", "access", "hex", "owned")
LEAST = {"assign": 12, "access": 18, "hex": 16}
# end of fixed values
BARE = r"[A-Za-z0-9+_=-]{20,}"
ENTROPY = 3.5
WIDE_OWNERS = 3
WIDE_REPOS = 20
SALT = 8

_assign = re.compile(ASSIGN, re.I | re.A).finditer
_access = re.compile(r"AKIA[A-Z0-9]{14,}").finditer  # the same as ACCESS with 18 characters or more
_hex = re.compile(r"[0-9a-f]{16,}").finditer
_bare = re.compile(BARE).finditer
_placeholder = re.compile(r"example|sample|dummy|changeme|placeholder|your|(.)\1{4,}", re.I | re.A).search

FOUND = ("rid long, doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base string, "
         "cands array<struct<start:long,stop:long,kind:int,hash:binary,live:boolean>>")
_ARROW = pa.schema([
    ("rid", pa.int64()), ("doc_id", pa.int64()), ("owner", pa.string()), ("repo", pa.string()), ("n_assign", pa.int64()),
    ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()),
    ("cands", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()),
                                  ("hash", pa.binary()), ("live", pa.bool_())])))])


def looks_live(value: str) -> bool:
    """Long and mixed enough to be random, and no placeholder."""
    if len(value) < 12 or not re.search("[0-9]", value) or not re.search("[A-Za-z]", value) or _placeholder(value):
        return False
    n = len(value)
    counts = [value.count(c) for c in set(value)]
    return -sum(c / n * math.log2(c / n) for c in counts) >= min(ENTROPY, 0.8 * math.log2(n))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, value) of the base spans, in order."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _assign(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end(), m[0]) for m in _access(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _hex(text)]
    return sorted(out)


def bare_tokens(text: str, base: list[tuple]) -> list[tuple[int, int, int, str]]:
    """Random-looking tokens that touch no base span."""
    out, i, reach = [], 0, 0
    for m in _bare(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach <= m.start() and looks_live(m[0]):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str | None = None) -> DataFrame:
    """Base spans and candidates of each row, one row each."""

    def run(batches):
        rid = partition_id() << 33
        for batch in batches:
            rows = []
            for doc, text, owner, repo in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                base = base_spans(text)
                cands = [{"start": a, "stop": b, "kind": k, "hash": hashlib.sha256(v.encode()).digest(), "live": looks_live(v)}
                         for a, k, b, v in base + bare_tokens(text, base)]
                n = [sum(s[1] == k for s in base) for k in range(3)]
                rows.append({"rid": rid, "doc_id": doc, "owner": "" if owner is None else f"={owner}", "repo": repo if repo is not None else str(rid),
                             "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base": spans_text(base), "cands": cands})
                rid += 1
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(owner_col).cast("string").alias("owner"),
                       (F.col(repo_col).cast("string") if repo_col else F.lit(None).cast("string")).alias("repo"))
    return with_python(rows).mapInArrow(run, FOUND)


def ownership(cands: DataFrame) -> DataFrame:
    """Per hash its distinct owners and repositories over the corpus."""
    return (cands.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"))
            .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repos")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str | None = None, wide_owners: int = WIDE_OWNERS,
         wide_repos: int = WIDE_REPOS) -> DataFrame:
    """Per row: base counts, base and all spans, and how many of its values are widely copied
    examples or live-looking values of one owner."""
    found = stored(find(docs, id_col, text_col, owner_col, repo_col), "secrets")
    cands = found.select("rid", "owner", "repo", F.explode("cands").alias("c")).select("rid", "owner", "repo", "c.*")
    seen = ownership(cands).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    judged = (cands.withColumn("salt", F.pmod(F.xxhash64("rid", "start"), F.lit(SALT)).cast("int"))
              .join(seen, ["hash", "salt"])
              .withColumn("wide", (F.col("owners") >= wide_owners) | (F.col("repos") >= wide_repos))
              .withColumn("specific", (F.col("owners") == 1) & ~F.col("wide") & F.col("live"))
              .filter((F.col("kind") < 3) | F.col("specific")))
    span = F.struct("start", "kind", "stop")
    per = judged.groupBy("rid").agg(
        F.collect_list(span).alias("all_spans"),
        F.sum((F.col("wide") & (F.col("kind") < 3)).cast("long")).alias("n_copied"),
        F.sum(F.col("specific").cast("long")).alias("n_owned"))
    return (found.select("rid", "doc_id", "n_assign", "n_access", "n_hex", "base").join(per, "rid", "left")
            .select("doc_id", "n_assign", "n_access", "n_hex", "base",
                    F.coalesce(_joined(F.col("all_spans")), F.lit("")).alias("spans"),
                    F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("n_owned", F.lit(0)).alias("n_owned")))


def _sql_matches(kind: int, pattern: str, value: str, keep: str) -> str:
    """Matches of ``pattern`` with their places: the text between matches gives the starts."""
    return f"""
  select rid, owner, {kind} as kind, start, start + length(m) as stop, {value} as value from (
    select rid, owner, unnest(ms) as m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
        list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda p: length(p))), 0)))::bigint as start
    from (select rid, owner, regexp_extract_all(t, '{pattern}') as ms, regexp_split_to_array(t, '{pattern}') as ps from d))
  where {keep}"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_A = ("(?:" + "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"),
                        _either("api") + "_?" + _either("key")]) + r""")["'']?\x20*[:=]\x20*["'']?""")
_V = f"regexp_replace(m, '^{_A}', '')"
_LIVE = f"""length(value) >= 12 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
  and not regexp_matches(value, '(?i)example|sample|dummy|changeme|placeholder|your')
  and not regexp_matches(lower(value), '{"|".join(f"[{c}]{{5}}" for c in "abcdefghijklmnopqrstuvwxyz0123456789+/_.=-")}')
  and list_entropy(list_transform(range(1, length(value) + 1), lambda i: value[i])) >= least(3.5, 0.8 * log2(length(value)))"""
OP1_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce('=' || source, '') as owner, coalesce(text, '') as t from documents),
b as ({_sql_matches(0, _A + "[A-Za-z0-9+/_.=-]+", _V, f"length({_V}) >= 12")}
  union all {_sql_matches(1, "AKIA[A-Z0-9]{14,}", "m", "true")}
  union all {_sql_matches(2, "[0-9a-f]{16,}", "m", "true")}),
w as ({_sql_matches(3, BARE, "m", "true")}),
c as (select * from b union all
  select * from w where not exists (select 1 from b where b.rid = w.rid and b.start < w.stop and b.stop > w.start)),
l as (select *, {_LIVE} as live from c),
k as (select * from l where kind < 3 or live),
o as (select value, count(distinct owner) as owners, count(distinct rid) as repos from k group by value),
j as (select k.*, owners >= {WIDE_OWNERS} or repos >= {WIDE_REPOS} as wide, owners = 1 and repos < {WIDE_REPOS} and live as specific
  from k join o using (value)),
p as (
  select rid, sum((kind = 0)::int)::bigint as n_assign, sum((kind = 1)::int)::bigint as n_access, sum((kind = 2)::int)::bigint as n_hex,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3) as base,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop, ',' order by start, kind) as spans,
    sum((wide and kind < 3)::int)::bigint as n_copied, sum(specific::int)::bigint as n_owned
  from j where kind < 3 or specific group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_copied, 0) as n_copied, coalesce(n_owned, 0) as n_owned
from d left join p using (rid)
"""


@register("op1_secrets", OP1_SQL)
def op1_secrets(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).withColumn("base_sha256", F.sha2(F.col("base").cast("binary"), 256)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_copied", "n_owned")
