"""Golden tests for the text functions (cleaning, tokens, dedupe key, tags)."""

import pytest
from pyspark.sql import functions as F

from credline.functions import text as TX

# Own samples (rules: drop lines without a letter; keep tokens longer than one character
# holding a letter, or "&").
CLEAN_CASES = [
    ("==Mara VO Lindgren CITY OF RIVERTON", "==Mara VO Lindgren CITY OF RIVERTON"),
    ("Guest of 27 8 Show Tomas Weil, Harbour & Sons 10 22 q la", "Guest of Show Tomas Weil, Harbour & Sons la"),
    ("X - 12\n99 :: 3\nT4K (07 Ok) b", "T4K Ok)"),
    ("A & B Co\n& 12\nX", "& Co"),
    ("", ""),
    ("été ok\tx　yy", "été ok yy"),
]


def _one(spark, col_expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col_expr.alias("r")).first()["r"]


@pytest.mark.parametrize("src,expected", CLEAN_CASES)
def test_clean_ocr_golden(spark, src, expected):
    assert _one(spark, TX.clean_ocr("t"), src) == expected


def test_clean_is_idempotent(spark):
    for src, _ in CLEAN_CASES:
        once = _one(spark, TX.clean_ocr("t"), src)
        assert _one(spark, TX.clean_ocr("t"), once) == once


def test_tokens_match_python_split(spark):
    samples = ["a b", "  lead and trail  ", "x y z　w", "p\x1cq\x1dr\x85s", "tab\tnl\nvt\x0bff\x0c"]
    for s in samples:
        assert _one(spark, TX.tokens("t"), s) == s.split()


def test_strip_matches_python(spark):
    for s in ["  a b  ", "　x ", "\n\tq\r\n", "none"]:
        assert _one(spark, TX.strip_ws("t"), s) == s.strip()


def test_dedupe_key_keeps_unicode_word_chars(spark):
    assert _one(spark, TX.dedupe_key("t"), " Foo_Été! 12 ") == "foo_été12"


def test_tag_all_o_and_untag_roundtrip(spark):
    s = "Ilse Marie\nBrandt"
    tagged = _one(spark, TX.tag_all_o("t"), s)
    assert tagged == "Ilse@O Marie@O Brandt@O"
    assert _one(spark, TX.untag("t"), tagged) == s.split()


def test_verbatim_check(spark):
    df = spark.createDataFrame(
        [("Stanley@BF:1 Kubrick@IF:1 Writer@BR:1", "Stanley Kubrick Writer"),
         ("Stanley@BF:1 Writer@BR:1", "Stanley Kubrick Writer"),
         ("a@b@O", "a@b")], "tagged string, text string")
    got = [r[0] for r in df.select(TX.verbatim_ok("tagged", "text")).collect()]
    assert got == [True, False, False]


def test_split_lines_stripped_keeps_empty_pieces(spark):
    assert _one(spark, TX.split_lines_stripped("t"), " a \n\nb\n") == ["a", "", "b", ""]


def test_append_joined_fold(spark):
    def fold(pieces):
        s = ""
        for r in pieces:
            s = r if not s else s + " " + r
        return s
    for pieces in [["a", "b"], ["", "", "a", "", "b"], [], ["", ""], ["x"]]:
        got = spark.createDataFrame([(pieces,)], "p array<string>").select(
            TX.append_joined("p")).first()[0]
        assert got == fold(pieces)


def test_na_literals(spark):
    df = spark.createDataFrame([("NA",), ("",), (" NA",), ("x",), ("null",)], "t string")
    got = [r[0] for r in df.select(TX.na_to_null("t")).collect()]
    assert got == [None, None, " NA", "x", None]
