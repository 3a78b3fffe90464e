"""Harmonic packing of tokenised documents into sequences of at most ``capacity`` ids.

A length r belongs to the reciprocal-capacity class k when capacity/(k+1) < r <=
capacity/k; every bin of class k takes exactly k pieces, so no bin is ever searched for
room and each worker fills its own bins without talking to the others.

Cutting keeps the classes tight. A document first gives whole sequences of ``capacity``
ids. A remainder r stays whole when a bin of k such pieces wastes at most ``slack`` ids
(capacity - k*r); otherwise a piece of floor(capacity/(k+1)) ids is cut off, which fills
class k+1 almost exactly, and the rest is classed again. At the end of a partition the
pieces of the unfinished bins (less than one bin a class) are laid end to end and cut at
``capacity``; the last open sequence is cut at powers of two, which need no padding.

Padding is therefore at most slack/capacity of the class bins and nothing elsewhere, for
any number of workers. Memory per worker: one Arrow batch, the word cache (bounded) and the
open bins (less than ``capacity`` ids a class).

Defined results: a null or empty text is the end id alone; repeated rows and null ids are
packed as documents of their own; an empty table gives no rows; other columns are ignored.
``sequence_id`` is (partition << 32) + running number, so a recomputed task gives the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credline.llm.common import partition_id, register, table, with_python

CAPACITY = 4096
SLACK = 32
END_ID = 2
CACHE_WORDS = 300_000
CACHED_LENGTH = 48
OUT_BYTES = 8 << 20

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64())])


class _Parts(dict):
    """Ids of the parts of plain words, from the tokenizer's model."""

    def __init__(self, tok):
        super().__init__()
        self.model = tok.model
        self.letters = dict(enumerate(_byte_letters()))
        self.ids = [i.to_bytes(4, "little") for i in range(tok.get_vocab_size())]

    def __missing__(self, part: str) -> bytes:
        letters = part.encode().decode("latin-1").translate(self.letters)
        ids = self.ids
        self[part] = out = b"".join([ids[t.id] for t in self.model.tokenize(letters)])
        return out


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: visible
    Latin-1 characters stand for themselves, the others for 256, 257, ... in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Encoder(dict):
    """Token ids (little-endian uint32 bytes) of whole texts; as a dict, of the words met.

    The tokenizer's normaliser and splitter never join characters across a blank or a line
    feed, so a text's ids are those of its blank-separated words in order. Words repeat, so
    their ids are kept in a bounded cache. A new word of ASCII and precomposed Latin letters
    is lower-cased and split here by the tokenizer's own rule, and its parts (cached as
    well) go to the tokenizer's model, provided the tokenizer agrees on a probe; any other
    word goes through the whole tokenizer, and so does a text that holds the opening of a
    special token.
    """

    PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]"
                       "|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+").findall
    PROBE = "Ab,c 12 it's \u00c9t\u00e9 \u00df'd (x_y) don't 3.5% we'll"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tok = Tokenizer.from_file(path)
        self.parts = _Parts(self.tok)
        self.plain = all(self._plain(w) == self._whole(w) for w in self.PROBE.split(" "))

    def _whole(self, text: str) -> bytes:
        import numpy as np

        found, = self.tok.encode_batch_fast([text], add_special_tokens=False)
        return np.asarray(found.ids, dtype="<u4").tobytes()

    def _plain(self, word: str) -> bytes:
        parts = self.parts
        return b"".join([parts[p] for p in self.PARTS(word.lower())])

    def __missing__(self, word: str) -> bytes:
        if not (self.plain and (word.isascii() and word.isprintable() or self.PLAIN(word))):
            ids = self._whole(word)
        elif word.isalpha():  # most words are letters, or letters and one sign: no pattern needed
            ids = self.parts[word.lower()]
        elif word[-1] in ".,;:!?" and word[:-1].isalpha():
            ids = self.parts[word[:-1].lower()] + self.parts[word[-1]]
        else:
            ids = self._plain(word)
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            if len(self) > CACHE_WORDS:
                self.clear()
                self[""] = b""
            if len(self.parts) > 2 * CACHE_WORDS:
                self.parts.clear()
            yield self._whole(t) if "<|" in t else b"".join([self[w] for w in t.replace("\n", " ").split(" ")])


def cuts(length: int, capacity: int, slack: int) -> Iterator[tuple[int, int]]:
    """(piece length, class) of a document's pieces, in order."""
    for _ in range(length // capacity):
        yield capacity, 1
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack:
            yield rest, k
            return
        piece = capacity // (k + 1)
        yield piece, k + 1
        rest -= piece


class Packer:
    """The bins of one worker."""

    def __init__(self, capacity: int, slack: int, worker: int):
        self.capacity, self.slack = capacity, slack
        self.bins: dict[int, list[tuple]] = {}
        self.next_id = worker << 32
        self.out: list[tuple] = []
        self.bytes = 0

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, ids, total, self.next_id, offset))
            offset += n
            self.bytes += len(ids) + 64
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        for n, k in cuts(total, self.capacity, self.slack):
            held = self.bins.setdefault(k, [])
            held.append((doc, start, ids[4 * start:4 * (start + n)], total))
            start += n
            if len(held) == k:
                self.close(held)
                del self.bins[k]

    def finish(self) -> None:
        """The unfinished bins end to end, cut at the capacity and at last at powers of two."""
        rest = [p for k in sorted(self.bins) for p in self.bins[k]]
        self.bins = {}
        left = sum(len(p[2]) // 4 for p in rest)
        room, held = 0, []
        for doc, start, ids, total in rest:
            while ids:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                n = min(room, len(ids) // 4)
                held.append((doc, start, ids[:4 * n], total))
                start, ids, room, left = start + n, ids[4 * n:], room - n, left - n
                if not room:
                    self.close(held)
                    held = []

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.out)) or [()] * len(_ARROW)
        self.out, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, slack: int = SLACK, end_id: int = END_ID) -> DataFrame:
    """One row per piece: its document, its place there, its ids (little-endian uint32
    bytes), and its sequence and offset. ``tokenizer`` is the path of a tokenizers file."""

    def run(batches):
        encode, packer = Encoder(tokenizer), Packer(capacity, slack, partition_id())
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                packer.add(doc, ids + end)
                if packer.bytes > OUT_BYTES:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_python(rows).mapInArrow(run, PIECES)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@register("op5_packing")
def op5_packing(spark, sf_dir):
    return digest(pack(table(spark, sf_dir, "documents"), tokenizer_path()))
