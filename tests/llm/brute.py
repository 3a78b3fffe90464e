"""Plain restatements of the contracts, used to check the operators on small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text) -> list[tuple]:
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def spans_text(spans, kinds) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text) -> set:
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def near_dup(rows, least=75) -> dict:
    """{doc_id: (n, component)} for (doc_id, text) rows with distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if 100 * i >= least * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def repeats(rows, width=50) -> dict:
    """{doc_id: (kept bytes, n spans)} for (doc_id, text) rows with distinct ids."""
    first, out = {}, {}
    rows = sorted((d, (t or "").encode()) for d, t in rows)
    for d, b in rows:
        for i in range(len(b) - width + 1):
            first.setdefault(b[i:i + width], d)
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i:i + width]] < d:
                gone[i:i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (bytes(x for x, g in zip(b, gone) if not g), spans)
    return out


def rebuilt(turns) -> dict:
    """{conv_id: [(role, text), ...]} for (conv_id, turn, role, text) rows."""
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]
    return out


def trie(turns) -> set:
    """The nodes of the prefix trie as (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends)."""
    convs = rebuilt(turns)
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(x[:len(q)] == q and len(x) > len(q) for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p))))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), len(leaves), saved, sha(ends)))
    return out


def ranked(docs, items, k=10) -> list:
    """(item_id, rank, doc_id, score) rows, an item a row of ``items``."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            m = 25 + (75 * sum(b.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                        for t in words(text) if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out
