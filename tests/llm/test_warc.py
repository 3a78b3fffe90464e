import base64
import hashlib
import io

import pytest
from pyspark.sql import types as T

from credline.llm import warc as W

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("k", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("salt", T.StringType())])
ROWS = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/\r\nX: y", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n"),
        (6, "u", "é\U0001f600" * 200_000), (7, "u", "<p>x</p>"), (8, "u", "once"), (8, "u", "once"), (None, "u", "once"), (None, None, "lone")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "a", "b", None) for r in ROWS], PAGES).repartition(3)


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark, pages):
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["valid"])
                  for r in W.round_trip(spark, pages).collect()), key=str)
    best = {}
    for i, _, h in ROWS:
        best[h or ""] = max(best.get(h or "", 0), i or 0)
    want = []
    for i, _, h in ROWS:
        top = best[h or ""]
        again = (i or 0) < top
        want.append((i or 0, len((h or "").encode()), b32(h), "revisit" if again else "response", top if again else None, True))
    assert got == sorted(want, key=str)


def test_small_payloads_are_all_responses(spark, pages):
    got = W.round_trip(spark, pages, min_payload=5)
    assert {r["page_id"] for r in got.collect() if r["record_type"] == "revisit"} == {1, 2}


def test_payloads_come_back(spark, pages):
    got = {r["page_id"]: r for r in W.round_trip(spark, pages, payloads=True).collect()}
    assert bytes(got[6]["payload"]).decode() == ROWS[5][2] and got[6]["url"] == "u"
    assert bytes(got[5]["payload"]).decode() == ROWS[4][2] and got[1]["payload"] is None
    assert got[3]["url"] == "http://b/%0D%0AX:%20y"  # control characters and blanks cannot break the header


def archive(*records):
    return b"".join(W.member(r) for r in records)


def test_damage_is_told():
    good = W.record(1, "u", b"payload", None)
    ok, = W.read_records(io.BytesIO(archive(good)))
    assert ok["valid"]
    bad, after = W.read_records(io.BytesIO(archive(good.replace(b"payload", b"pAyload"), good)))
    assert bad["why"] == "block digest" and after["valid"]
    longer, = W.read_records(io.BytesIO(archive(good[:-4] + b"..\r\n\r\n")))
    assert longer["why"] == "bad end"
    short, = W.read_records(io.BytesIO(archive(good[:-8])))
    assert short["why"] in ("short block", "bad end") and not short["valid"]


def why(data):
    return [(r["why"], r["page_id"]) for r in W.read_records(io.BytesIO(data))]


def test_unreadable_parts_do_not_end_the_archive():
    """Truncation, broken gzip data, garbage and incomplete headers give a row each; the records
    around them are read."""
    one, two = W.member(W.record(1, "u", b"payload " * 9000, None)), W.member(W.record(2, "v", b"other", None))
    assert why(two + one[:-10]) == [(None, 2), ("the archive ends inside a member", 1)]
    flipped = bytearray(one)
    flipped[len(one) // 2] ^= 0xFF
    assert [w for w, _ in why(two + bytes(flipped) + two)] in ([None, "broken gzip data", None], [None, "block digest", None])
    assert why(two + b"no gzip at all" * 3) == [(None, 2), ("broken gzip data", None)]
    assert why(b"\x1f\x8b\x08 a false start " + two + two) == [("broken gzip data", None), (None, 2), (None, 2)]
    assert why(W.member(b"hello") + two + W.member(b"")) == [("no WARC header", None), (None, 2), ("no WARC header", None)]
    assert why(W.member(b"WARC/1.1\r\nWARC-Type: response\r\n") + two) == [("a record ends inside its header", None), (None, 2)]
    assert why(W.member(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nabc") + two) == [("no content length", None), (None, 2)]
    assert why(b"") == []


def test_other_record_types_pass_through():
    info = W.member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n")
    first, page = W.read_records(io.BytesIO(info + archive(W.record(1, "u", b"payload", None))))
    assert (first["record_type"], first["page_id"], first["valid"], first["payload_bytes"]) == ("warcinfo", None, True, 9)
    assert page["valid"] and page["record_type"] == "response"


def test_empty_table(spark, pages):
    assert W.round_trip(spark, pages.limit(0)).count() == 0
