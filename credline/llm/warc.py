"""WARC archives: write records, read them back sequentially.

Writing. Payloads are grouped by (SHA-1, length); of a group with more than one row the
largest id stays a response and the others become revisits. The groups are joined back
salted by id, so a payload that a third of all pages share is dealt over ``SALT`` tasks.
Each task writes archives of about ``archive_bytes`` below the shared folder, one gzip
member per record, and returns their names; only names that a finished task returned are
read, so the files of a lost or repeated attempt are never seen twice (each attempt writes
under its own name).

Reading. One pass over each file in small blocks: ``zlib.decompressobj`` per member, its
unused tail starts the next member; the header block ends at the empty line, the
Content-Length frames the block, the payload starts after the HTTP header. Payload and block
digests are checked as the bytes pass, as far as the record names them. A broken frame or
digest, a header that is none, a missing length, broken gzip data and an archive that ends early
each give one row with ``valid`` = false and the reason; reading goes on with the next record,
after broken data at the next place that looks like a gzip member and holds one. Records of other
types (``warcinfo``, ``request``) come through with their type. Memory: one read block, a header
and, only if ``payloads`` is asked for, one record, however long the payload.

Defined results: a null html is the empty payload; an empty table gives no rows; of repeated
rows with the largest id each is a response; a null id is below every id (if a group has
null ids only, all are responses); control characters of a url are escaped; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credline.llm.common import register, stored, table, with_python
from credline.session import scratch_path

SALT = 16
ARCHIVE_BYTES = 64 << 20
BLOCK = 1 << 16
MAGIC = b"\x1f\x8b\x08"
LONGEST_HEADER = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:credline:page:"


def plan_records(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id",
                 url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to (the response's id for a revisit, else null)."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"))
    keyed = rows.withColumns({"k": F.unhex(F.sha1("payload")), "n": F.octet_length("payload"),
                              "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALT))})
    groups = (rows.select("page_id", F.unhex(F.sha1("payload")).alias("k"), F.octet_length("payload").alias("n"))
              .filter(F.col("n") >= min_payload).groupBy("k", "n")
              .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("m"))
              .filter("m > 1").select("k", "n", "response", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt")))
    joined = keyed.join(groups, ["k", "n", "salt"], "left")
    refers = F.when(F.col("response") > F.coalesce("page_id", F.lit(-(1 << 63))), F.col("response"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC record, uncompressed."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>",
             "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``plan_records`` as archives in ``folder`` (a shared folder of any
    file system Arrow knows). Lazy: returns path, records, bytes, a row per archive."""

    def run(batches):
        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)
        out, path, n, size = None, None, 0, 0
        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)
                data = member(record(page, url, payload, refers))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return with_python(records.select("page_id", "url", "payload", "refers_to")).mapInArrow(
        run, "path string, records long, bytes long")


class Damage(Exception):
    """What keeps a member from being read; ``head`` has the record's header, as far as it is known."""

    def __init__(self, why: str, head: dict | None = None):
        super().__init__(why)
        self.why, self.head = why, head or {}


class _Members:
    """The decompressed bytes of a stream of gzip members, one member at a time."""

    def __init__(self, stream):
        self.stream, self.tail, self.z = stream, b"", None

    def start(self) -> bool:
        if not self.tail:
            self.tail = self.stream.read(BLOCK)
        self.z = zlib.decompressobj(31) if self.tail else None
        return self.z is not None

    def read(self) -> bytes:
        """Some more bytes of this member, empty at its end."""
        while not self.z.eof:
            data = self.tail or self.stream.read(BLOCK)
            if not data:
                self.tail = b""
                raise Damage("the archive ends inside a member")
            try:
                got = self.z.decompress(data, BLOCK)
            except zlib.error:
                self.tail = data
                raise Damage("broken gzip data") from None
            self.tail = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                return got
        return b""


    def resync(self) -> None:
        """Go on to the next place that looks like the start of a gzip member."""
        data = self.tail[1:]
        while (at := data.find(MAGIC)) < 0:
            more = self.stream.read(BLOCK)
            if not more:
                self.tail = b""
                return
            data = data[-(len(MAGIC) - 1):] + more
        self.tail = data[at:]


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _id(value: str | None):
    value = (value or "").strip("<>").removeprefix(ID_PREFIX)
    return int(value) if value.lstrip("-").isdigit() else None


def read_records(stream, payloads: bool = False) -> Iterator[dict]:
    """The records of one archive, in order. What cannot be read gives a row with the reason, and
    reading goes on at the next member that holds a record."""
    members, lost = _Members(stream), False
    while members.start():
        try:
            row = _record(members, payloads)
        except Damage as e:
            if not lost:
                yield _row(e.head, e.why)
            lost = True
            members.resync()
            continue
        if lost and row["why"] == NO_HEADER:  # not a record: the place only looked like a start
            continue
        lost = False
        yield row


NO_HEADER = "no WARC header"


def _row(head: dict, why: str | None, **found) -> dict:
    return {"page_id": _id(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "payload_bytes": None,
            "payload_digest": None, "record_type": head.get("warc-type"), "refers_to": _id(head.get("warc-refers-to")),
            "valid": why is None, "why": why, "payload": None} | found


def _record(members: _Members, payloads: bool) -> dict:
    data, head = b"", {}

    def drained(why: str) -> dict:
        while members.read():
            pass
        return _row(head, why)

    try:
        while (at := data.find(b"\r\n\r\n", 0, LONGEST_HEADER)) < 0:
            if not b"WARC/".startswith(data[:5]) or len(data) > LONGEST_HEADER:
                return drained(NO_HEADER)
            more = members.read()
            if not more:
                return _row(head, "a record ends inside its header" if data.startswith(b"WARC/") else NO_HEADER)
            data += more
        if not data.startswith(b"WARC/"):
            return drained(NO_HEADER)
        head, data = _headers(data[:at]), data[at + 4:]
        if not head.get("content-length", "").isdigit():
            return drained("no content length")
        left = int(head["content-length"])
        block, body, seen, http, kept = hashlib.sha1(), hashlib.sha1(), 0, b"", []
        in_http = head.get("content-type", "").startswith("application/http")
        http_head: dict[str, str] = {}
        while left:
            part, data = data[:left], data[left:]
            left -= len(part)
            block.update(part)
            if in_http:
                http += part
                if (at := http.find(b"\r\n\r\n")) >= 0:
                    http_head, part, in_http = _headers(http[:at]), http[at + 4:], False
                else:
                    part = b""
            body.update(part)
            seen += len(part)
            if payloads:
                kept.append(part)
            if left and not data:
                data = members.read()
                if not data:
                    break
        while more := members.read():
            data = (data + more)[:5]  # an end of more than four bytes is wrong, however long
    except Damage as e:
        raise Damage(e.why, head) from None
    revisit = head.get("warc-type") == "revisit"
    b32 = lambda h: base64.b32encode(h.digest()).decode()
    told = lambda name: head[name].removeprefix("sha1:") if name in head else None
    digest, length = told("warc-payload-digest"), http_head.get("content-length", "")
    length = int(length) if length.isdigit() else seen
    why = ("short block" if left else "bad end" if data != b"\r\n\r\n"
           else "block digest" if told("warc-block-digest") not in (None, b32(block))
           else "payload digest" if not revisit and digest not in (None, b32(body))
           else "payload length" if not revisit and seen != length else None)
    return _row(head, why, payload_bytes=length if revisit else seen, payload_digest=b32(body) if digest is None and not revisit else digest,
                payload=b"".join(kept) if payloads and not revisit else None)


RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, valid boolean, why string, payload binary")
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("valid", pa.bool_()), ("why", pa.string()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archives named in column ``path``; a file is one unit of work."""

    def run(batches):
        files, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for row in read_records(stream, payloads):
                        rows.append(row)
                        size += 200 + len(row["payload"] or b"")
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return with_python(archives.select("path")).mapInArrow(run, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, min_payload: int = 0, payloads: bool = False) -> DataFrame:
    """Write all pages to archives in the shared folder, then read them back."""
    folder = scratch_path(spark, "warc")
    written = stored(write_archives(plan_records(pages, min_payload), folder), "warc-archives")
    n = spark.sparkContext.defaultParallelism
    return read_archives(written.select("path").repartition(4 * n), folder, payloads)


_BITS = "cast(unhex(sha1(coalesce(html, ''))) as bit)::varchar"
OP3_SQL = f"""
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, coalesce(html, '') as h, {_BITS} as b
  from pages),
d as (
  select page_id, payload_bytes, h,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + 16 * substr(b, (5*i+1)::int, 1)::int + 8 * substr(b, (5*i+2)::int, 1)::int
        + 4 * substr(b, (5*i+3)::int, 1)::int + 2 * substr(b, (5*i+4)::int, 1)::int
        + substr(b, (5*i+5)::int, 1)::int, 1)), 'string_agg', '') as payload_digest
  from p),
g as (select h, max(page_id) as response from p where payload_bytes >= 0 group by h)
select page_id, payload_bytes, payload_digest,
  case when page_id < response then 'revisit' else 'response' end as record_type,
  case when page_id < response then response end as refers_to, true as valid
from d join g using (h)
"""


@register("op3_warc", OP3_SQL)
def op3_warc(spark, sf_dir):
    return round_trip(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")
