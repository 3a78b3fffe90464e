"""Personal data: base patterns plus information-theoretic sanitisation, in DataFrame
operations only.

Base spans (patterns below) name protected entities. Over all documents, for a term t (a word
outside base spans) and an entity e:

* disclosure(t, e) = documents that hold both / documents that contain t, an estimate of P(e | t);
* bits(t, e) = log2(P(e | t) / P(e)), the information t gives away about e.

A pair that at least ``SUPPORT`` differing documents hold, with disclosure of ``GENERALISE`` or more
and at least ``BITS`` bits, gives e away even where e itself is blanked, and most of all where e does
not stand. Such terms become further spans (kind ``term``) wherever they stand as whole words
outside base spans, in every document; the sanitised text removes those whose largest disclosure
is ``REMOVE`` or more and writes a general mark for the others. Base spans always stay.

Co-occurrence is counted over whole documents, however far t stands from e. Copies count as one
towards ``SUPPORT``: documents differ, as to e, by the ``CONTEXT`` characters to both sides of e (of
several occurrences the text that sorts first). Equal rows count as one document.

Corpus counts are taken in steps, each on what can still pass. Entities come first: one in fewer
than ``SUPPORT`` differing documents, or in so many that no term can carry ``BITS`` bits about it (an
address in a third of all documents), is out before any pair is formed. Then the words of the
documents that hold one of the others are paired with these and counted with partial aggregates;
their counts there bound the disclosure from above. The words of the whole corpus are looked up
only for terms that can still pass (broadcast after a check of their number; beyond it the join
shuffles words already made distinct per document), once for the counts and the places. Only texts
with a passing term are searched for the places. A document pairs its own words with its own
entities, which a very long list of addresses makes many; rows of a text find it again by 128 bits.

Defined results: a null text is empty and has no spans; a null id is kept; repeated rows give
equal rows; other columns are ignored; an empty table gives no rows. Spans that
start together go by kind; a term of equal disclosure for several entities is one span. Very long
texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credline.llm.common import free_name, register, stored, table, wide_key

KINDS = ("email", "ip", "card", "phone", "term")
# The base patterns. Where a pattern can only begin at the start of a run, (?<!..) says so,
# \G lets a match follow the one before it at once, and ++ keeps runs whole: the same matches
# as without these, in linear time and without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"[\p{L}]{3,}"
CONTEXT = 80
SUPPORT = 3
GENERALISE = 0.5
REMOVE = 0.9
BITS = 3.0
BROADCAST_ROWS = 1_000_000
BLOCK = 256  # words whose places are found in one go
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _spans(text: str, pattern: str, kind: int, gate: Column, keep) -> tuple[dict, Column]:
    """Columns with the matches and the text between them, and the spans made of these."""
    m, p = f"__m{kind}", f"__p{kind}"
    none = F.array().cast("array<string>")
    cols = {m: F.when(gate, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none),
            p: F.when(gate, F.split(text, pattern, -1)).otherwise(none)}
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        stop = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["m"].alias("value"))
        return F.struct(stop.alias("at"), F.when(keep(x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    pairs = F.arrays_zip(F.col(m).alias("m"), F.slice(p, 1, F.size(m)).alias("p"))
    return cols, F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def base_spans(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the base spans of the string column ``text`` by start, then kind."""
    t = F.col(text)
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    parts = [
        _spans(text, EMAIL, 0, F.contains(t, F.lit("@")), lambda m: F.lit(True)),
        _spans(text, IP, 1, t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        _spans(text, CARD, 2, t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
               lambda m: F.length(digits(m)).between(14, 19) & F.call_function("luhn_check", digits(m))),
        _spans(text, PHONE, 3, F.contains(t, F.lit("+")), lambda m: F.length(digits(m)).between(10, 15)),
    ]
    found = docs.withColumns({k: v for cols, _ in parts for k, v in cols.items()})
    found = found.withColumn(out, F.array_sort(F.concat(*[c for _, c in parts])))
    return found.drop(*[k for cols, _ in parts for k in cols])


def _entities(text: Column, spans: Column) -> Column:
    """Of each span the entity and the text around it."""
    def one(s):
        start = F.greatest(s["start"] - CONTEXT, F.lit(0))
        return F.struct(F.sha2(F.lower(s["value"]).cast("binary"), 256).alias("e"),
                        F.substring(text, start + 1, s["stop"] + CONTEXT - start).alias("around"))
    return F.transform(spans, one)


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), F.lower))


def _checked(terms: DataFrame) -> DataFrame:
    """``terms``, to be broadcast if their number allows it."""
    return F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms


def _places(found: DataFrame) -> DataFrame:
    """k, places (start, kind, stop, removed; sorted) of the passing terms (``gone`` those to remove,
    ``general`` the others) of each text of ``found`` (k, text, spans, gone, general) outside its base
    spans. Lengths are summed up per block of words and then over the blocks, so a text of many words
    takes no quadratic time. The columns that the lambdas use are read from storage or used twice:
    Spark would move a column that is used once into the lambda and work it out for every word."""
    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        stop = start + F.length(x["m"])
        word = F.lower(x["m"])
        place = F.struct(start.alias("start"), stop.alias("stop"), F.array_contains("gone", word).alias("removed"))
        hit = F.array_contains("gone", word) | F.array_contains("general", word)
        return F.struct(stop.alias("at"), F.when(hit, F.concat(acc["out"], F.array(place))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,removed:boolean>>").alias("out"))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__words"), F.lit(1)), F.lit(BLOCK)),
                         lambda i: F.aggregate(F.slice("__words", i, BLOCK), zero, step))
    begins = F.aggregate("__blocks", F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))

    def placed(b, j):
        at = F.get("__begins", j)
        return F.transform(b["out"], lambda o: F.struct((at + o["start"]).alias("start"), F.lit(4).alias("kind"),
                                                        (at + o["stop"]).alias("stop"), o["removed"].alias("removed")))

    rows = (found.withColumns({"__m": F.regexp_extract_all("text", F.lit(TERM), 0), "__p": F.split("text", TERM, -1)})
            .withColumn("__words", F.arrays_zip(F.col("__m").alias("m"), F.slice("__p", 1, F.size("__m")).alias("p")))
            .withColumn("__blocks", blocks).withColumn("__begins", begins))
    free = F.filter(F.flatten(F.transform("__blocks", placed)),
                    lambda t: ~F.exists("spans", lambda s: (s["start"] < t["stop"]) & (s["stop"] > t["start"])))
    # filtered behind the aggregate: a filter below it would find the places twice
    return (rows.select("k", free.alias("places")).groupBy("k").agg(F.first("places").alias("places"))
            .filter(F.size("places") > 0))


def disclosures(texts: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, e, disclosure of the pairs that pass; k, term of all documents that hold a term which
    had a chance to). ``texts`` is k, text and ``own`` k, spans, entities; equal rows are one document."""
    n_all = own.select("k").distinct().count()
    marks = (own.filter(F.size("entities") > 0).select("k", F.explode("entities").alias("x"))
             .groupBy("k", F.col("x.e").alias("e")).agg(F.xxhash64(F.min("x.around")).alias("c")))
    of_e = (marks.groupBy("e").agg(F.count(F.lit(1)).alias("n_e"), F.count_distinct("c").alias("n_c"))
            .filter((F.col("n_c") >= SUPPORT) & (F.log2(F.lit(n_all) / F.col("n_e")) >= BITS)).select("e", "n_e"))
    held = marks.join(of_e, "e").groupBy("k").agg(F.collect_list(F.struct("e", "c", "n_e")).alias("es"))
    spans = own.select("k", F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["stop"], F.lit(True).alias("removed"))).alias("spans"))
    rows = texts.join(held, "k").groupBy("k").agg(F.first("text").alias("text"), F.first("es").alias("es"))
    rows = rows.join(spans, "k").groupBy("k").agg(*[F.first(c).alias(c) for c in ("text", "es", "spans")])
    words = stored(rows.select("k", "es", F.explode(_words(sanitise(F.col("text"), F.col("spans"), " "))).alias("term")), "pii-words")
    pairs = (words.select("term", F.inline("es")).groupBy("term", "e", "n_e", "c").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("term", "e", "n_e").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("support")).filter(F.col("support") >= SUPPORT))
    here = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_here"))
    pairs = stored(pairs.join(here, "term").filter(F.col("n_te") >= GENERALISE * F.col("n_here")), "pii-pairs")
    wanted = _checked(pairs.select("term").distinct())
    holds = stored(texts.select("k", F.explode(_words(F.col("text"))).alias("term")).join(wanted, "term", "left_semi").distinct(), "pii-holds")
    df = holds.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    p = F.col("n_te") / F.col("n_t")
    told = (pairs.join(df, "term").withColumn("disclosure", p)
            .filter((p >= GENERALISE) & (F.log2(p * F.lit(n_all) / F.col("n_e")) >= BITS)).select("term", "e", "disclosure"))
    return told, holds


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k (row key), doc_id, spans (base), places (array of start, kind, stop, removed: all occurrences
    of passing terms, removed by the term's largest disclosure): one row per document."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                        wide_key(id_col, text_col).alias("k"))
    own = stored(base_spans(texts, "text", "spans").select(
        "doc_id", "k", F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["stop"])).alias("spans"),
        _entities(F.col("text"), F.col("spans")).alias("entities")), "pii-spans")
    told, holds = disclosures(texts.select("k", "text"), own)
    largest = _checked(stored(told.groupBy("term").agg((F.max("disclosure") >= REMOVE).alias("removed")), "pii-told"))
    hits = holds.join(largest, "term").groupBy("k").agg(
        F.collect_list(F.when(F.col("removed"), F.col("term"))).alias("gone"),
        F.collect_list(F.when(~F.col("removed"), F.col("term"))).alias("general"))
    hits = own.select("k", "spans").join(hits, "k").groupBy("k").agg(*[F.first(c).alias(c) for c in ("spans", "gone", "general")])
    places = _places(texts.join(stored(hits, "pii-hits"), "k"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,removed:boolean>>")
    return (own.select("doc_id", "k", "spans").join(places, "k", "left")
            .withColumn("places", F.coalesce("places", none)))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def sanitise(text: Column, spans: Column, gone: str = "") -> Column:
    """``text`` with each span (start, kind, stop, removed; sorted) replaced by its kind's
    mark, or if removed by ``gone``. Spans that touch are blanked together under the first one's mark."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        mark = F.when(s["removed"], F.lit(gone)).otherwise(F.element_at(marks, s["kind"] + 1))
        more = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                        F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    def finish(acc):
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text) - acc["at"]))
    return F.aggregate(spans, zero, step, finish)


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span blanked in the text column; the other columns are unchanged."""
    key, spans = free_name(docs, "k"), free_name(docs, "spans")
    base = F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["stop"], F.lit(False).alias("removed")))
    found = (find(docs, id_col, text_col).filter((F.size("spans") > 0) | (F.size("places") > 0)).dropDuplicates(["k"])
             .select(F.col("k").alias(key), F.array_sort(F.concat(base, F.col("places"))).alias(spans)))
    text = F.col(text_col).cast("string")
    joined = docs.withColumn(key, wide_key(id_col, text_col)).join(found, key, "left")
    return joined.withColumn(text_col, F.when(F.col(spans).isNotNull(), sanitise(text, F.col(spans))).otherwise(text)).select(*docs.columns)


@register("op7_pii")
def op7_pii(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    plain = F.transform("places", lambda s: F.struct(s["start"], s["kind"], s["stop"]))
    return found.select(
        "doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"),
        F.sha2(spans_text(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("spans", plain))).alias("spans"), F.size("places").cast("long").alias("n_terms"))
