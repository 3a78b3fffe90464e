"""Language of a text by cross-parsing against suffix automata of labelled text.

For each language a bounded sample of labelled text (``SAMPLE_CHARS`` characters) becomes a
suffix automaton, whose walk gives the longest match from any place of a text. A text is cut
greedily into phrases, each the longest string that also occurs in the sample; phrases times
log2(sample length) estimates its code length under that language, and the language with the
smallest wins (a tie: the smaller name). All languages parse the head of the text; the rest is
parsed in that order, and a language is given up once it has passed the best so far, which
cannot change the winner.

The sample: of each language's labelled rows that are not held out, the rows with the smallest
hashes of their id in ``BUCKETS`` hash buckets, the first ``ROW_CHARS`` characters of each.
Every language is learned: with more than ``MAX_LANGUAGES`` of them each has fewer buckets and
characters, so that the total stays that of ``MAX_LANGUAGES`` full samples, down to one row and
``LEAST_CHARS`` characters (from some 40,000 languages on the total grows again). This bound concerns learning only; every text is parsed whole.

Defined results: a null text, or one without any letter, is ``und`` with score 0, as is every
text when nothing was learned; rows with a null id, text or language are not learned from, but
predicted; the score is 1 - phrases per character (a letter unseen in learning ends a phrase);
repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credline.llm.common import fold, held_out, register, table, with_python

SAMPLE_CHARS = 40_000
ROW_CHARS = 1_000
BUCKETS = 64
MAX_LANGUAGES = 200  # with a full sample each
LEAST_CHARS = 200
HEAD = 256
STEP = 4096
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
_LETTER = re.compile(r"[^\W\d_]").search


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Sample text by language: at most SAMPLE_CHARS characters for each language, and smaller
    samples where there are more than MAX_LANGUAGES languages, so its size is bounded."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"),
                       F.xxhash64(F.col(id_col).cast("long")).alias("h"))
    rows = rows.filter("i is not null and t is not null and l is not null").filter(fold("i") != 2)
    n = rows.select("l").distinct().count()
    if not n:
        return {}
    buckets = max(1, min(BUCKETS, BUCKETS * MAX_LANGUAGES // n))
    chars = max(LEAST_CHARS, min(SAMPLE_CHARS, SAMPLE_CHARS * MAX_LANGUAGES // n))
    lowest = rows.groupBy("l", F.pmod("h", F.lit(buckets)).alias("b")).agg(F.min("h").alias("h"))
    hashes = {(r["l"], r["h"]) for r in lowest.select("l", "h").collect()}
    found = (rows.filter(F.col("h").isin(sorted({h for _, h in hashes}))).groupBy("l", "h")
             .agg(F.min(F.substring("t", 1, ROW_CHARS)).alias("t")).collect())
    texts: dict[str, list] = {}
    for r in found:
        if (r["l"], r["h"]) in hashes:
            texts.setdefault(r["l"], []).append((r["h"], r["t"]))
    out = {k: "\0".join(t.lower() for _, t in sorted(v))[:chars] for k, v in texts.items()}
    return {k: v for k, v in out.items() if v}


def automaton(text: str) -> dict:
    """The suffix automaton of ``text`` as nested dicts: root[c1][c2]... exists exactly for
    the substrings."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    for d in nxt:
        for c, i in d.items():
            d[c] = nxt[i]
    return nxt[0]


def phrases(root: dict, text: str, state: dict, n: int) -> tuple[dict, int]:
    """Continue a cross-parse: the state after ``text`` and the phrases ended so far."""
    get = root.get
    for c in text:
        state = state.get(c)
        if state is None:
            n += 1
            state = get(c, root)
    return state, n


class Parser:
    def __init__(self, model: dict[str, str]):
        self.names = sorted(model)
        self.roots = [automaton(model[k]) for k in self.names]
        self.bits = [math.log2(len(model[k]) + 1) for k in self.names]

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not _LETTER(text):
            return "und", 0.0
        text = text.lower()
        heads = []
        for i, root in enumerate(self.roots):
            state, n = phrases(root, text[:HEAD], root, 0)
            heads.append((n * self.bits[i], i, state, n))
        best = None
        for _, i, state, n in sorted(heads, key=lambda x: x[:2]):
            root, bits = self.roots[i], self.bits[i]
            for at in range(HEAD, len(text), STEP):
                if best is not None and n * bits > best[0]:
                    break
                state, n = phrases(root, text[at:at + STEP], state, n)
            best = min(best, (n * bits, i, n)) if best is not None else (n * bits, i, n)
        return self.names[best[1]], max(0.0, 1 - best[2] / len(text))


_PARSERS: dict[str, Parser] = {}


def parser(model: dict[str, str]) -> Parser:
    """One parser per worker process."""
    key = hashlib.sha256(repr(sorted(model.items())).encode()).hexdigest()
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(model)
    return _PARSERS[key]


def predict(docs: DataFrame, model: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        parse = parser(model)
        for batch in batches:
            got = [parse(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()),
                                              pa.array([x for _, x in got], pa.float64())], schema=_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    return with_python(rows).mapInArrow(run, PREDICTED)


@register("op6_language")
def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
