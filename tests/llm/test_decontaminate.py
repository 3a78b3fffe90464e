import random
import re

from pyspark.sql import functions as F

from credline.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        ws = words(t)
        for a in range(max(len(ws) - window, 0) + 1) if ws else ():
            wins.setdefault(tuple(ws[a:a + window]), set()).add(i)
    out = []
    for d, t in docs:
        ws, hit, ids = words(t), set(), set()
        for n in {len(w) for w in wins}:
            for a in range(len(ws) - n + 1):
                w = tuple(ws[a:a + n])
                if w in wins:
                    hit.update(range(a, a + n))
                    ids |= wins[w]
        out.append((d, len(ws), len(hit), ",".join(sorted(str(i) for i in ids if i is not None))))
    return sorted(out, key=str)


def run(docs, items):
    got = D.match(docs, items).select("doc_id", "n_words", D.n_covered(F.col("hits")).alias("n"), F.array_join("item_ids", ",").alias("ids"))
    return sorted((tuple(r) for r in got.collect()), key=str)


def tables(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "a", "É", "b1", "Zz", "rare%d", "long"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocab).replace("%d", str(rng.randint(0, 30))) for _ in range(n))
    items = [(i, text(rng.choice([12, 25, 40]))) for i in range(12)]
    items += [(20, "one"), (21, "two words"), (22, "three whole words"), (23, None), (24, " .,"), (None, text(15)), (25, items[0][1]), (3, text(14)),
              (26, "the " * 15)]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            ws = words(rng.choice(items)[1])
            a = rng.randint(0, max(len(ws) - 9, 0))
            t += rng.choice([" ", ". "]) + " ".join(ws[a:a + rng.randint(8, 20)]).upper().replace("É", "É") + " " + text(rng.randint(0, 9))
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "the " * 200), (None, items[2][1]), (4, items[4][1]), (4, items[4][1]), (103, "ONE two  words")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = tables(3)
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, k string, h string").repartition(3)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, w string")
    want = brute(docs, items)
    assert run(d, i) == want and any(x[2] for x in want) and not all(x[2] for x in want)
    clean = D.without_contaminated(d, i)
    assert clean.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(x[0]) for x in want if not x[2])


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    docs, items = tables(4)
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


def test_messy_rows(spark, messy, messy_rows):
    items = [(1, "one two"), (2, "gamma delta epsilon alpha beta gamma delta epsilon alpha beta gamma"), (None, None)]
    assert run(messy, spark.createDataFrame(items, "item_id long, text string")) == brute([r[:2] for r in messy_rows], items)


def test_empty_tables(spark, empty, documents):
    items = spark.createDataFrame([], "item_id long, text string")
    assert {(r["n"], r["ids"]) for r in D.match(documents, items).select(F.size("hits").alias("n"), F.array_join("item_ids", ",").alias("ids")).collect()} == {(0, "")}
    assert D.without_contaminated(documents, items).count() == documents.count()
    assert D.match(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_native(spark, documents):
    plan = D.match(documents, spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
