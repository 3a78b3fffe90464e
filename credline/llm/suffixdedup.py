"""Exact substring de-duplication by a distributed merge sort of suffixes.

A byte goes when it is covered by a ``WIDTH``-byte string that also starts in a document with a
smaller id. Which suffixes to sort is chosen by content: every WIDTH-byte window names one
anchor, the place of its ``GRAM``-byte string with the smallest hash (the leftmost of equals),
so equal windows have their anchors at equal places wherever they stand. All windows of an
anchor lie within its suffix (WIDTH bytes) and the WIDTH - GRAM bytes before it. About every
14th suffix is an anchor; nothing is sampled, every window has one.

1. Documents are written once, whole, as chunks of about ``CHUNK`` bytes.
2. Anchors' gram hashes are exchanged in buckets, distinct per chunk; a bitmap tells each chunk
   which of its grams some other chunk has too. Other anchors (but those repeated within the
   chunk) cannot be part of a match.
3. Each chunk sorts its remaining suffixes, keeps equal ones once with their smallest document,
   and cuts the sorted run at the range borders. Runs are front-coded: for each string the
   length of the prefix shared with the one before, and the rest.
4. Each range merges its runs with a loser tree that carries longest common prefixes: of two
   strings with different common prefixes with the last output the longer wins unread, equal
   ones are compared from there on, and a front-coded string arrives with its prefix known.
   Strings meet in groups of one gram, in which the smallest document of every window is found.
   What changes for a string goes back to its chunk. A gram with more than ``GROUP`` occurrences
   (counted with the bitmaps) stays out of the ranges: every chunk sends the distinct windows of
   its strings with their smallest document, and an aggregate finds the smallest of all.
5. Chunks apply the answers to all their occurrences and cut the texts.

A passage that a third of all documents hold is one string per chunk in the exchange. Range
borders are quantiles of a sample of ``SAMPLE`` prefixes a chunk; they only balance the work.
Hash collisions only add candidates: strings are compared in full.

Defined results: a null text is empty; nothing is removed for rows of the same id, so repeated
rows keep each other; a null id counts as larger than all; other columns are ignored; an empty
table gives no rows. A text of any length is one chunk; it must fit a task's memory some times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credline.llm.common import partition_id, register, stored, table, with_python

WIDTH = 50
GRAM = 24
LEFT = WIDTH - GRAM
ROW = 80  # suffix, reversed left context, their two lengths, padding: ten 8-byte words
CHUNK = 8 << 20
SEGMENT = 1 << 20
BUCKET_GRAMS = 2_000_000
RANGE_BYTES = 16 << 20
GROUP = 50_000
SAMPLE = 64
NO_ID = (1 << 63) - 1
_C1, _C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


def _pack(*arrays) -> bytes:
    return pa.compress(b"".join(a.tobytes() for a in arrays), codec="zstd", asbytes=True)


def _unpack(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)


# ------------------------------------------------------------------------------- chunks
CHUNKS = "chunk long, n long, ids binary, known binary, lens binary, data binary, sample array<long>"


def _prefix_order(x: np.ndarray) -> np.ndarray:
    """Unsigned 8-byte prefixes as signed numbers of the same order."""
    return (x ^ np.uint64(1 << 63)).astype(np.int64)


def _chunk_row(chunk: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    data = b"".join(texts)
    at = np.linspace(0, max(len(data) - 8, 0), SAMPLE).astype(int) if len(data) >= 8 else []
    sample = np.array([int.from_bytes(data[i:i + 8], "big") for i in at], np.uint64)
    return pa.RecordBatch.from_arrays([
        pa.array([chunk]), pa.array([len(data)]), pa.array([np.array([NO_ID if i is None else i for i in ids], np.int64).tobytes()], pa.binary()),
        pa.array([np.array([i is not None for i in ids], np.uint8).tobytes()], pa.binary()),
        pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()),
        pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary()),
        pa.array([_prefix_order(sample).tolist()], pa.list_(pa.int64()))],
        names=["chunk", "n", "ids", "known", "lens", "data", "sample"])


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    def run(batches):
        chunk = partition_id() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = (t or "").encode()
                if texts and size + len(t) > chunk_bytes:
                    yield _chunk_row(chunk, ids, texts)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield _chunk_row(chunk, ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return with_python(rows).mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk's texts end to end, their anchors, and what derives from these."""

    def __init__(self, row, buckets: int):
        self.data = _unpack(row["data"], int(row["n"]))
        self.buf = np.frombuffer(self.data, np.uint8)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.ends = np.cumsum(np.frombuffer(row["lens"], np.int64))
        self.begins = np.concatenate(([0], self.ends[:-1]))
        parts = list(self._anchors())
        none = np.empty(0, np.int64)
        self.p, self.lo, self.hi, self.d, h = ([np.concatenate(x) for x in zip(*parts)] if parts
                                               else [none, none, none, none, none.astype(np.uint64)])
        h = (h ^ (h >> np.uint64(31))) * _C2
        h ^= h >> np.uint64(33)
        code = (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & _LOW)
        self.order = np.argsort(code, kind="stable")
        code = code[self.order]
        self.first = np.flatnonzero(np.concatenate((code[:1] == code[:1], code[1:] != code[:-1])))
        self.codes = code[self.first]
        self.borders = np.searchsorted(self.codes, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))

    def _anchors(self) -> Iterator[tuple]:
        """place, first and last window start, document index, gram hash of each anchor."""
        n = len(self.buf)
        for a in range(0, n - WIDTH + 1, SEGMENT):
            b = min(a + SEGMENT, n - WIDTH + 1)
            part = self.buf[a:b + WIDTH - 1]
            x = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, 8)).view(np.uint64).ravel()
            m = len(part) - GRAM + 1
            h = np.zeros(m, np.uint64)
            for i in range(0, GRAM, 8):
                h = (h ^ x[i:i + m]) * _C1
                h ^= h >> np.uint64(29)
            h *= _C2
            h ^= h >> np.uint64(32)
            win = (h & ~_LOW) | np.arange(m, dtype=np.uint64)
            size, span = 1, WIDTH - GRAM + 1
            while size * 2 <= span:
                win = np.minimum(win[:-size], win[size:])
                size *= 2
            if size < span:
                win = np.minimum(win[:len(win) - (span - size)], win[span - size:])
            arg = (win & _LOW).astype(np.int64)
            d0, d1 = np.searchsorted(self.ends, [a, b - 1], "right")
            held = np.minimum(self.ends[d0:d1 + 1], b) - np.maximum(self.begins[d0:d1 + 1], a)
            d = np.repeat(np.arange(d0, d1 + 1), np.maximum(held, 0))
            ok = np.arange(a + WIDTH, b + WIDTH) <= np.repeat(self.ends[d0:d1 + 1], np.maximum(held, 0))
            s, arg, d = np.flatnonzero(ok) + a, arg[ok], d[ok]
            if not len(s):
                continue
            new = np.flatnonzero(np.concatenate(([True], (arg[1:] != arg[:-1]) | (d[1:] != d[:-1]))))
            yield arg[new] + a, s[new], s[np.append(new[1:], len(s)) - 1], d[new], h[arg[new]]

    def grams(self) -> Iterator[tuple[int, bytes, bytes]]:
        """bucket, sorted distinct gram codes in it, place and number of those that occur more
        than once."""
        low = (self.codes & _LOW).astype(np.uint32)
        times = np.diff(np.append(self.first, len(self.order)))
        for b in np.flatnonzero(np.diff(self.borders)).tolist():
            n = times[self.borders[b]:self.borders[b + 1]]
            more = np.flatnonzero(n > 1)
            yield b, low[self.borders[b]:self.borders[b + 1]].tobytes(), np.concatenate((more, n[more])).astype(np.uint32).tobytes()

    def suffixes(self, bitmaps: dict[int, bytes], hot: dict[int, bytes]) -> None:
        """Sort the suffixes of the anchors that may match. Sets rows (distinct sorted strings),
        least (their smallest document), at (occurrences, sorted), starts (of the rows there),
        cold and hot (the rows that go to the ranges, and those of hot grams)."""
        shared = [np.unpackbits(np.frombuffer(bitmaps[b], np.uint8), count=int(n)) for b, n in
                  enumerate(np.diff(self.borders).tolist()) if n]
        shared = np.concatenate(shared).astype(bool) if shared else np.empty(0, bool)
        ids = self.ids[self.d[self.order]]
        if len(ids):
            shared |= np.minimum.reduceat(ids, self.first) != np.maximum.reduceat(ids, self.first)
        times = np.diff(np.append(self.first, len(self.order)))
        at = np.sort(self.order[np.repeat(shared, times)])
        p, d = self.p[at], self.d[at]
        rows = np.zeros((len(at), ROW), np.uint8)
        pad = np.zeros(WIDTH, np.uint8)
        right = np.minimum(self.ends[d] - p, WIDTH) if len(at) else p
        left = np.minimum(p - self.begins[d], LEFT) if len(at) else p
        if len(at):
            rows[:, :WIDTH] = np.lib.stride_tricks.sliding_window_view(np.concatenate((self.buf, pad)), WIDTH)[p]
            back = np.concatenate((self.buf[::-1], pad))
            rows[:, WIDTH:WIDTH + LEFT] = np.lib.stride_tricks.sliding_window_view(back, LEFT)[len(self.buf) - p]
            rows[:, :WIDTH][np.arange(WIDTH) >= right[:, None]] = 0
            rows[:, WIDTH:WIDTH + LEFT][np.arange(LEFT) >= left[:, None]] = 0
            rows[:, WIDTH + LEFT], rows[:, WIDTH + LEFT + 1] = right, left
        words = rows.view(">u8").astype(np.uint64)
        order = np.lexsort(words.T[::-1])
        words = words[order]
        new = np.concatenate((np.ones(min(1, len(at)), bool), (words[1:] != words[:-1]).any(axis=1)))
        self.starts = np.flatnonzero(new)
        self.at = at[order]
        self.rows, self.heads = rows[order][new], words[new, 0]
        self.least = np.minimum.reduceat(self.ids[self.d[self.at]], self.starts) if len(at) else np.empty(0, np.int64)
        often = np.zeros(len(self.codes), bool)
        for b, places in hot.items():
            often[self.borders[b] + np.frombuffer(places, np.uint32).astype(np.int64)] = True
        anchors = np.zeros(len(self.order), bool)
        anchors[self.order] = np.repeat(often, times)
        own = anchors[self.at[self.starts]]
        self.cold, self.hot = np.flatnonzero(~own), np.flatnonzero(own)

    def windows(self, t: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of the strings of hot grams, with the windows that begin t bytes before the anchor:
        the strings that have one inside the text, the number of its window, the windows."""
        x = self.rows[self.hot]
        at = self.hot[(x[:, WIDTH + LEFT] >= WIDTH - t) & (x[:, WIDTH + LEFT + 1] >= t)]
        x = self.rows[at]
        text = np.concatenate((x[:, WIDTH:WIDTH + t][:, ::-1], x[:, :WIDTH - t]), axis=1).tobytes()
        keys = np.empty(len(at), object)
        keys[:] = [text[i:i + WIDTH] for i in range(0, len(text), WIDTH)]
        number, distinct = pd.factorize(keys)
        return at, number, distinct.tolist()

    def hot_runs(self) -> Iterator[tuple[int, int, int, bytes]]:
        """t, windows, bytes, blob (smallest and largest document of each window, windows)."""
        for t in range(LEFT + 1 if len(self.hot) else 0):
            at, number, distinct = self.windows(t)
            if distinct:
                low, high = np.full(len(distinct), NO_ID), np.full(len(distinct), -NO_ID - 1)
                np.minimum.at(low, number, self.least[at])
                np.maximum.at(high, number, self.least[at])
                yield t, len(distinct), len(distinct) * WIDTH, _pack(low, high, np.frombuffer(b"".join(distinct), np.uint8))

    def hot_answers(self, t: int, window: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The strings whose window at t stands in a smaller document: ``doc`` is the smallest of
        each numbered ``window``."""
        at, number, distinct = self.windows(t)
        best = np.full(len(distinct), NO_ID)
        best[window] = doc
        return at[best[number] < self.least[at]]

    def runs(self, borders: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        """range, index of the first string, strings, front-coded run."""
        rows, least = (self.rows[self.cold], self.least[self.cold]) if len(self.hot) else (self.rows, self.least)
        if not len(rows):
            return
        differ = rows[1:] != rows[:-1]
        lcp = np.concatenate(([0], differ.argmax(axis=1))).astype(np.uint8)
        cut = np.searchsorted(_prefix_order(self.heads[self.cold]), borders)
        for r, (i, j) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(rows)])):
            if i < j:
                own = lcp[i:j].copy()
                own[0] = 0
                rest = rows[i:j][np.arange(ROW) >= own[:, None]]
                yield r, i, j - i, len(rest), _pack(own, least[i:j], rest)

    def cut(self, index: np.ndarray, first: np.ndarray, last: np.ndarray) -> pd.DataFrame:
        """The texts without what goes. The answers: windows from place + first to place + last
        of every occurrence of string ``index`` stand in a smaller document."""
        at, starts = self.at, self.starts
        times = np.diff(np.append(starts, len(at)))
        later = self.ids[self.d[at]] > np.repeat(self.least, times)
        lo, hi = [self.lo[at][later]], [self.hi[at][later]]
        n = times[index]
        each = np.repeat(np.arange(len(index)), n)
        occ = at[starts[index][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
        a, b = np.maximum(self.p[occ] + first[each], self.lo[occ]), np.minimum(self.p[occ] + last[each], self.hi[occ])
        lo, hi = np.concatenate([*lo, a[a <= b]]), np.concatenate([*hi, b[a <= b]]) + WIDTH
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
        d = np.searchsorted(self.ends, lo, "right")
        reach = np.maximum.accumulate(hi) if len(hi) else hi
        new = np.concatenate((np.ones(min(1, len(lo)), bool), (lo[1:] > reach[:-1]) | (d[1:] != d[:-1])))
        run = np.flatnonzero(new)
        lo, hi, d = lo[run], reach[np.append(run[1:], len(reach))[:len(run)] - 1] if len(run) else reach, d[run]
        spans = np.bincount(d, minlength=len(self.ids))
        gone = np.bincount(d, hi - lo, minlength=len(self.ids)).astype(np.int64)
        kept, i = [], 0
        for begin, end, n in zip(self.begins.tolist(), self.ends.tolist(), spans.tolist()):
            out = []
            for x, y in zip(lo[i:i + n].tolist(), hi[i:i + n].tolist()):
                out.append(self.data[begin:x])
                begin = y
            i += n
            kept.append(b"".join([*out, self.data[begin:end]]))
        return pd.DataFrame({"n_bytes": self.ends - self.begins, "n_removed": gone, "n_spans": spans, "kept": kept})


# ------------------------------------------------------------------------------- exchanges
def _shared_grams(rows: pd.DataFrame, group: int) -> pd.DataFrame:
    """Of one bucket: for every chunk the bitmap of its grams that another chunk has too, and the
    places of those with more than ``group`` occurrences in all."""
    rows = rows.sort_values("chunk")
    lists = [np.frombuffer(x, np.uint32) for x in rows["blob"]]
    values = np.concatenate(lists)
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    flag = np.zeros(len(values), bool)
    flag[order[1:][same]] = flag[order[:-1][same]] = True
    ends = np.cumsum([len(x) for x in lists])
    times = np.ones(len(values), np.int64)
    for begin, more in zip([0, *ends[:-1].tolist()], rows["more"]):
        at, n = np.frombuffer(more, np.uint32).astype(np.int64).reshape(2, -1)
        times[begin + at] = n
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), ~same)))
    hot = np.zeros(len(values), bool)
    if len(values):
        hot[order] = np.repeat(np.add.reduceat(times[order], first) > group, np.diff(np.append(first, len(values))))
    cut = ends[:-1]
    return pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "part": rows["part"].to_numpy(),
                         "blob": [np.packbits(x).tobytes() for x in np.split(flag, cut)],
                         "hot": [np.flatnonzero(x).astype(np.uint32).tobytes() for x in np.split(hot, cut)]})


def merge(runs: list[tuple[bytes, list[int], bytes]]) -> Iterator[tuple[int, bytes, int, int]]:
    """Loser-tree merge of front-coded runs (prefix lengths, ends of the rests, rests): yields the
    prefix shared with the output before, the string, its run and its place there."""
    k = len(runs)
    cur: list[bytes | None] = [None] * k
    lcp, pos = [0] * k, [0] * k
    for r, (own, ends, rest) in enumerate(runs):
        cur[r] = rest[:ends[0]]

    def beats(a: int, b: int) -> bool:
        """Does a's string come out before b's? Sets the loser's common prefix with the winner."""
        x, y = cur[a], cur[b]
        if x is None or y is None:
            return y is None
        n = lcp[a]
        if n != lcp[b]:
            return n > lcp[b]
        u, v = x[n:], y[n:]
        if u == v:
            lcp[max(a, b)] = ROW
            return a < b
        d = int.from_bytes(u) ^ int.from_bytes(v)
        n = ROW - (d.bit_length() + 7) // 8
        if u < v:
            lcp[b] = n
            return True
        lcp[a] = n
        return False

    tree = [0] * max(k, 1)

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            tree[node] = b
            return a
        tree[node] = a
        return b

    w = play(1) if k > 1 else 0
    while cur[w] is not None:
        x, i = cur[w], pos[w]
        yield lcp[w], x, w, i
        own, ends, rest = runs[w]
        pos[w] = i = i + 1
        if i < len(own):
            n = own[i]
            lcp[w] = n
            cur[w] = x[:n] + rest[ends[i - 1]:ends[i]]
        else:
            cur[w] = None
        node = (w + k) >> 1
        while node:
            b = tree[node]
            if beats(b, w):
                tree[node] = w
                w = b
            node >>= 1


def _windows(x: bytes) -> Iterator[tuple[int, bytes]]:
    """t, the window that begins t bytes before the anchor, for the windows inside the text."""
    right, left = x[WIDTH + LEFT], x[WIDTH + LEFT + 1]
    for t in range(max(0, WIDTH - right), left + 1):
        yield t, x[WIDTH:WIDTH + t][::-1] + x[:WIDTH - t]


def _smallest(strings: dict[bytes, int]) -> dict[bytes, list[tuple[int, int, int]]]:
    """For each string of one gram (with its smallest document): (first t, last t, document) where
    another string of the gram has a window of it in a smaller document."""
    if len(strings) == 2:  # the windows two strings share follow from their common prefixes
        (x, m), (y, n) = strings.items()
        if m == n:
            return {}
        right = next((i for i in range(GRAM, WIDTH) if x[i] != y[i]), WIDTH)
        left = next((i for i in range(LEFT) if x[WIDTH + i] != y[WIDTH + i]), LEFT)
        right = min(right, x[WIDTH + LEFT], y[WIDTH + LEFT])
        left = min(left, x[WIDTH + LEFT + 1], y[WIDTH + LEFT + 1])
        if WIDTH - right > left:
            return {}
        return {y if m < n else x: [(WIDTH - right, left, min(m, n))]}
    best: dict[tuple[int, bytes], int] = {}
    for x, doc in strings.items():
        for w in _windows(x):
            if doc < best.get(w, NO_ID + 1):
                best[w] = doc
    out = {}
    for x, doc in strings.items():
        found: list[tuple[int, int, int]] = []
        for w in _windows(x):
            m = best[w]
            if m < doc:
                if found and found[-1][1] == w[0] - 1:
                    found[-1] = (found[-1][0], w[0], min(m, found[-1][2]))
                else:
                    found.append((w[0], w[0], m))
        if found:
            out[x] = found
    return out


ANSWERS = "chunk long, n long, blob binary, w binary, doc long, idx long, t int"


def _hot_windows(row) -> pd.DataFrame:
    """The windows of one chunk's strings of hot grams at one t, one row each."""
    n, t = int(row["n"]), int(row["first"])
    data = _unpack(row["blob"], 16 * n + int(row["size"]))
    text = data[16 * n:]
    return pd.DataFrame({"chunk": row["chunk"], "n": pd.array(np.frombuffer(data, np.int64, n, 8 * n), "Int64"), "blob": None,
                         "w": [t.to_bytes(1) + text[i:i + WIDTH] for i in range(0, len(text), WIDTH)],
                         "doc": pd.array(np.frombuffer(data, np.int64, n), "Int64"), "idx": pd.array(np.arange(n), "Int64"),
                         "t": pd.array(np.full(n, t), "Int32")})


def _merge_range(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one range: the answers to every chunk. A negative number stands for the windows of one
    chunk at one t, which are handed on (n: their largest document)."""
    if rows["part"].iloc[0] < 0:
        return _hot_windows(rows.iloc[0])
    rows = rows.sort_values("chunk")
    runs, docs = [], []
    for n, size, blob in zip(rows["n"], rows["size"], rows["blob"]):
        data = _unpack(blob, int(9 * n + size))
        ends = np.cumsum(ROW - np.frombuffer(data, np.uint8, n).astype(np.int64))
        runs.append((data[:n], ends.tolist(), data[9 * n:]))
        docs.append(np.frombuffer(data[n:9 * n], np.int64).tolist())
    chunks, begins = rows["chunk"].tolist(), rows["first"].tolist()
    answers: list[list[tuple[int, int, int]]] = [[] for _ in runs]
    held: list[tuple[bytes, int, int, int]] = []
    strings: dict[bytes, int] = {}

    def settle() -> None:
        if len(held) < 2:
            return
        if len(strings) == 1:
            (m,) = strings.values()
            for _, r, i, doc in held:
                if doc > m:
                    answers[r].append((begins[r] + i, 0, LEFT))
            return
        found = _smallest(strings)
        for x, r, i, doc in held:
            m = strings[x]
            if m < doc:  # another chunk has the same string in a smaller document
                answers[r].append((begins[r] + i, 0, LEFT))
            elif x in found:
                answers[r].extend((begins[r] + i, a, b) for a, b, _ in found[x])

    for n, x, r, i in merge(runs):
        if n < GRAM:
            settle()
            held, strings = [], {}
        doc = docs[r][i]
        held.append((x, r, i, doc))
        if doc < strings.get(x, NO_ID + 1):
            strings[x] = doc
    settle()
    out = []
    for r, found in enumerate(answers):
        if found:
            idx, a, b = (np.array(v) for v in zip(*found))
            out.append((chunks[r], len(idx), _pack(idx.astype(np.int64), a.astype(np.int8), b.astype(np.int8)), None, None, None, None))
    return pd.DataFrame(out, columns=["chunk", "n", "blob", "w", "doc", "idx", "t"]).astype(
        {"n": "Int64", "doc": "Int64", "idx": "Int64", "t": "Int32"})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   chunk_bytes: int = CHUNK, range_bytes: int = RANGE_BYTES,
                   group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes): one row per row."""
    chunks = stored(chunked(docs, id_col, text_col, chunk_bytes), "suffix-chunks")
    total = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, int(total // 13 // BUCKET_GRAMS) + 1, min(64, int(total >> 20)))
    ranges = max(1, int(total // range_bytes) + 1, min(48, int(total >> 20)))
    cuts = [i / ranges for i in range(1, ranges)]
    borders = (chunks.select(F.explode("sample").alias("s")).agg(F.percentile_approx("s", cuts, 100_000).alias("b")).first()["b"]
               if cuts else None) or []

    def grams(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                for part, blob, more in Chunk(row, buckets).grams():
                    yield pd.DataFrame({"chunk": [row["chunk"]], "part": [part], "blob": [blob], "more": [more]})

    sent = chunks.select("chunk", "n", "ids", "known", "lens", "data").mapInPandas(grams, "chunk long, part int, blob binary, more binary")
    bitmaps = stored(sent.groupBy("part").applyInPandas(lambda rows: _shared_grams(rows, group), "chunk long, part int, blob binary, hot binary"), "suffix-grams")

    def ready(row, parts) -> Chunk:
        chunk = Chunk(row, buckets)
        chunk.suffixes(dict(zip(parts["part"], parts["blob"])), dict(zip(parts["part"], parts["hot"])))
        return chunk

    def runs(own, parts):
        out = []
        for row in own.to_dict("records"):
            chunk = ready(row, parts)
            out += [(row["chunk"], *run) for run in chunk.runs(np.array(borders, np.int64))]
            out += [(row["chunk"], -1 - (row["chunk"] * (LEFT + 1) + t), t, n, size, blob) for t, n, size, blob in chunk.hot_runs()]
        return pd.DataFrame(out, columns=["chunk", "part", "first", "n", "size", "blob"])

    data = chunks.select("chunk", "n", "ids", "known", "lens", "data")
    sorted_runs = data.groupBy("chunk").cogroup(bitmaps.groupBy("chunk")).applyInPandas(
        runs, "chunk long, part long, first long, n long, size long, blob binary")
    merged = stored(sorted_runs.groupBy("part").applyInPandas(_merge_range, ANSWERS), "suffix-answers")
    large = merged.filter("w is not null")
    late = (large.join(large.groupBy("w").agg(F.min("doc").alias("m")), "w").filter("m < n")
            .select("chunk", F.col("m").alias("n"), F.lit(None).cast("binary").alias("blob"), "idx", "t"))
    replies = merged.filter("blob is not null").select("chunk", "n", "blob", "idx", "t").unionByName(late).select(
        "chunk", F.lit(None).cast("int").alias("part"), "n", "blob", "idx", "t", F.lit(None).cast("binary").alias("hot")).unionByName(
        bitmaps.select("chunk", "part", F.lit(None).cast("long").alias("n"), "blob", F.lit(None).cast("long").alias("idx"),
                       F.lit(None).cast("int").alias("t"), "hot"))

    def apply(own, got):
        bits = got[got["part"].notna()]
        blobs = got[got["part"].isna() & got["blob"].notna()]
        single = got[got["idx"].notna()]
        index, first, last = ([np.empty(0, np.int64)] for _ in range(3))
        for n, blob in zip(blobs["n"].astype(int), blobs["blob"]):
            raw = _unpack(blob, 10 * n)
            index.append(np.frombuffer(raw, np.int64, n))
            last.append(-np.frombuffer(raw, np.int8, n, 8 * n).astype(np.int64))
            first.append(-np.frombuffer(raw, np.int8, n, 9 * n).astype(np.int64))
        out = []
        for row in own.to_dict("records"):
            chunk = ready(row, bits.assign(part=bits["part"].astype(int)))
            index = [chunk.cold[x] for x in index]
            for t, found in single.groupby("t"):
                x = chunk.hot_answers(int(t), found["idx"].to_numpy(np.int64), found["n"].to_numpy(np.int64))
                index.append(x)
                first.append(np.full(len(x), -int(t)))
                last.append(np.full(len(x), -int(t)))
            done = chunk.cut(np.concatenate(index), np.concatenate(first), np.concatenate(last))
            known = np.frombuffer(row["known"], np.uint8).astype(bool)
            done.insert(0, "doc_id", pd.array(chunk.ids, "Int64").copy())
            done.loc[~known, "doc_id"] = pd.NA
            out.append(done)
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return data.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(
        apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


@register("op2_suffixdedup")
def op2_suffixdedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
