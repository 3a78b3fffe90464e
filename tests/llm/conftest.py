import pytest
from pyspark.sql import types as T

LONG = ("alpha beta gamma delta epsilon " * 30_000) + "mail long.one@example.org end"

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("k", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("rid", T.StringType()), T.StructField("n", T.StringType())])

BASE = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "one two", "en", "a"),
    (5, "password = Zx9Qw8Er7Ty6Ui5 and mail a.b@c.de or +49 (30) 1234-5678 at 10.0.0.1", "de", "a"),
    (6, "Café \U0001f600 secret: 'Zx9Qw8Er7Ty6Ui5' card 4111 1111 1111 1111 ip 300.1.1.1", "fr", "b"),
    (7, LONG, "en", "b"), (8, LONG + " tail", None, "c"),
    (9, "one two", "en", "a"), (9, "one two", "en", "a"),  # repeated rows
    (None, "one two", "en", "a"), (None, None, None, None),
    (10, "9" * 5_000 + "." + "a" * 70_000 + "@", "en", "a"), (11, "KEY Kſ İ x", "es", "c"),
]


@pytest.fixture(scope="session")
def messy_rows():
    return [(i, t, lang, s, None if t is None else len(t), "x", "y", None, "z", "r", None) for i, t, lang, s in BASE]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
