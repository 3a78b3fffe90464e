import re

import pytest
from pyspark.sql import functions as F

from credline.llm import pii as P
from tests.llm import brute

CASES = ["", "a@b.co_x@d.com e@f", "x.y%z+1@a-b.c-d.e. q@w..e @a.b", "1.2.3.4.5.6.7.8 001.2.3.255 256.1.1.1 1.2.3",
         "4111 1111-1111 1111 4111111111111112 41111111111111110000 4111  1111 1111 1111", "+49 (30) 1234-5678) +1-2 ++12345678901 +123456789012345678",
         "+12 345 678 901 10.0.0.1 4111111111111111@a.bc", "é\U0001f600a@b.cd \U0001f6001.2.3.4", "a" * 60_000 + "@", "1" * 60_000, "1 " * 30_000,
         "a@b" + ".c" * 30_000, "+1" + "(" * 50_000, "1.1.1." * 9_000]


def base(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return {r["i"]: [(s["start"], s["kind"], s["stop"]) for s in r["found"]] for r in P.base_spans(df, "text", "found").collect()}


def test_base_spans_against_the_plain_patterns(spark, documents):
    got = base(spark, CASES)
    for i, t in enumerate(CASES):
        assert got[i] == brute.pii_base(t), t[:60]
    rows = documents.select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in P.find(documents).collect()}
    for r in rows:
        assert [(s["start"], s["kind"], s["stop"]) for s in found[r["doc_id"]]["spans"]] == brute.pii_base(r["text"])


def told(rows):
    """Brute force of the co-occurrence rule: (document, start, stop, removed) of added spans."""
    word = r"[^\W\d_]{3,}"
    docs = {d: t or "" for d, t in rows}
    spans = {d: brute.pii_base(t) for d, t in docs.items()}
    holds = {d: {m.lower() for m in re.findall(word, t)} for d, t in docs.items()}
    around, outside = {}, {}
    for d, t in docs.items():
        rest, at = "", 0
        for a, _, b in spans[d]:
            e, ctx = t[a:b].lower(), t[max(a - P.CONTEXT, 0):b + P.CONTEXT]
            around.setdefault(e, {})[d] = min(around.get(e, {}).get(d, ctx), ctx)
            rest, at = rest + (t[at:a] + " " if a >= at else ""), max(at, b)
        outside[d] = {m.lower() for m in re.findall(word, rest + t[at:])}
    removed = {}
    for e, of in around.items():
        for term in set().union(*(outside[d] for d in of)):
            both = [d for d in of if term in outside[d]]
            n_t = sum(term in ws for ws in holds.values())
            p = len(both) / n_t if n_t else 0
            if len({of[d] for d in both}) >= P.SUPPORT and p >= P.GENERALISE and p * len(docs) / len(of) >= 2**P.BITS:
                removed[term] = removed.get(term, False) or p >= P.REMOVE
    return {(d, m.start(), m.end(), removed[m[0].lower()]) for d, t in docs.items() for m in re.finditer(word, t)
            if m[0].lower() in removed and not any(s < m.end() and e > m.start() for s, _, e in spans[d])}


def people():
    rows = [(i, f"note {i}: the captain Zebulon wrote to zeb@sea.org about matter {chr(97 + i) * 4}") for i in range(4)]
    rows += [(10 + i, f"report {i}: pilot Quillon, quil@air.org, spoke {chr(97 + i) * 5}") for i in range(4)]
    rows += [(20 + i, f"quillon seen {i}") for i in range(2)]  # generalised: told by 4 of 6
    rows += [(30 + i, f"the captain and the pilot wrote a note about the matter, report spoke {i}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "quillon"), (103, "copy of one@x.org with Marvin"), (104, "copy of one@x.org with Marvin")]
    return rows


def test_terms_that_give_an_entity_away(spark):
    rows = people()
    got = P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["doc_id"], s["start"], s["stop"], s["removed"]) for r in got for s in r["places"]}
    assert found == told(rows) and found
    words = {dict(rows)[d][a:b] for d, a, b, _ in found}
    assert {"Zebulon", "Quillon"} <= words and not {"captain", "pilot", "Marvin"} & words
    assert {w for d, a, b, gone in found if not gone for w in [dict(rows)[d][a:b]]} >= {"Quillon"}


@pytest.mark.parametrize("times", [2, 3])
def test_repeated_rows_are_one_document(spark, times):
    """A table with every row twice or more gives every row the spans it has alone."""
    view = lambda rows: {(r["doc_id"], tuple(r["spans"]), tuple(r["places"]))
                         for r in P.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    once = view(people())
    assert view(people() * times) == once and any(places for *_, places in once)


def test_a_name_far_from_its_entity_gives_it_away(spark):
    rows = [(i, f"number {i}: far@off.org {'the long filler of a page ' * 40}{chr(97 + i) * 4} signed Ostrava") for i in range(4)]
    rows += [(10 + i, f"same@copy.org and Marvin, copy {'x1 ' * 40} number {chr(97 + i) * 4}") for i in range(4)]  # one context: copies
    rows += [(20 + i, f"the long filler of a page, number {i}, signed by hand; copy and number") for i in range(60)]
    got = P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["doc_id"], s["start"], s["stop"], s["removed"]) for r in got for s in r["places"]}
    assert found == told(rows)
    assert {dict(rows)[d][a:b] for d, a, b, _ in found} == {"Ostrava"}


def test_places_against_the_plain_rule(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = {(r["doc_id"], s["start"], s["stop"], s["removed"]) for r in P.find(documents).collect() for s in r["places"]}
    assert got == told(rows)


def test_sanitised_texts(spark):
    docs = spark.createDataFrame([(d, t, "z") for d, t in people()], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["text"] for r in P.sanitised(docs).collect()}
    assert len(got) == len(people()) and got[100] is None and got[101] == ""
    assert got[0] == "note 0: the captain  wrote to [EMAIL] about matter aaaa"
    assert "[TERM], [EMAIL]" in got[10] and got[30] == dict(people())[30]


def test_telling_terms_go_wherever_they_stand(spark):
    far = "quil@air.org and Quillon" + " ." * 100 + " QUILLON, quillons, " + "x1 yy2 word " * 700 + "quillon@sea.org Quillon"
    rows = [*people(), (200, far), (201, far), (201, far), *((300 + i, f"filler {i}") for i in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in P.find(docs).collect()}
    assert {(s["start"], s["stop"], s["removed"]) for s in found[20]["places"]} == {(0, 7, False)}
    own = [(s["start"], s["stop"]) for s in found[200]["places"]]
    assert [far[a:b] for a, b in own] == ["Quillon", "QUILLON", "Quillon"] and own[2][1] == len(far)
    got = {r["doc_id"]: r["text"] for r in P.sanitised(docs).collect()}
    assert got[20] == "[TERM] seen 0" and got[102] == "[TERM]" and got[0].startswith("note 0: the captain  wrote")
    assert got[200] == got[201] and "quillon" not in got[200].lower().replace("quillons", "") and "[TERM], quillons," in got[200]


def test_sanitise_overlaps(spark):
    df = spark.range(1).select(F.lit("0123456789").alias("t"))
    span = lambda a, k, b, r: F.struct(F.lit(a).alias("start"), F.lit(k).alias("kind"), F.lit(b).alias("stop"), F.lit(r).alias("removed"))
    out = df.select(P.sanitise(F.col("t"), F.array(span(1, 0, 5, False), span(3, 2, 7, False), span(8, 4, 9, True))).alias("x"))
    assert out.first()["x"] == "0[EMAIL]79"


def test_messy_rows(messy, messy_rows):
    got = P.find(messy).collect()
    assert len(got) == len(messy_rows)
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    assert sorted(((r["doc_id"], str([(s["start"], s["kind"], s["stop"]) for s in r["spans"]])) for r in got), key=key) == sorted(
        ((r[0], str(brute.pii_base(r[1]))) for r in messy_rows), key=key)
    clean = P.sanitised(messy)
    assert clean.columns == messy.columns and clean.count() == len(messy_rows)


def test_empty_table(empty):
    assert P.find(empty).count() == 0 and P.sanitised(empty).count() == 0


def test_places_read_their_base_spans(spark, monkeypatch):
    """The base spans of a text are read, not worked out again for each of its words."""
    plans, places = [], P._places

    def seen(found):
        out = places(found)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out
    monkeypatch.setattr(P, "_places", seen)
    P.find(spark.createDataFrame(people(), "doc_id long, text string"))
    assert len(plans) == 1 and "exists(" in plans[0] and "luhn" not in plans[0]
