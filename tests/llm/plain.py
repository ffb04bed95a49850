"""Plain-Python forms of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import xxhash

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, hash string, uid string, "
    "score string, bucket bigint, record string, _ string"
)


def table_of(spark, rows):
    """Documents (id, text, source) with columns whose names operators use inside."""
    return spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t), 1, "h", "u", None, 3, "r", "_") for i, t, s in rows], SCHEMA
    )


LONG = " ".join(f"word{i % 977}x{i * 7919 % 1013}" for i in range(20_000))
ODD = [
    (None, "No id but a text.", "a"),
    (None, None, None),
    (1, None, "a"),
    (1, None, "a"),
    (2, "", None),
    (3, LONG, "b"),
    (4, LONG, "b"),
    (5, "one", "c"),
    (5, "two", "c"),
    (6, "  \n\t ", "c"),
    (7, "x" * 5_000, "a"),
    (8, "é😀 ñandú " * 40, "a"),
    (9, "é😀 ñandú " * 40, "d"),
    (9, "é😀 ñandú " * 40, "d"),
]


def spark_hash(*values) -> int:
    """xxhash64 as Spark has it: each value hashed with the hash of those before as the seed."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        h = xxhash.xxh64(raw, seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def order_minhash(text: str, slots: int, k: int) -> list[int]:
    units = [u for w in text.split() for u in (w if len(w) > 24 else [w])]
    n = len(units)
    grams = [spark_hash(*units[i : i + k]) for i in range(n - k + 1)] if n >= k else [spark_hash(u) for u in units]
    cut = lambda h: (h & ((1 << 40) - 1)) - (1 << 40 if h >> 39 & 1 else 0)
    seen, elements = defaultdict(int), []
    for at, g in enumerate(grams):
        g = cut(g)
        elements.append((cut(spark_hash((g, 8), (seen[g], 4))), at))
        seen[g] += 1
    elements.sort()
    if not elements:
        return [-1] * slots
    out = []
    for j in range(slots):
        mark = (j - slots // 2) * ((1 << 40) // slots)
        first = sum(h < mark for h, _ in elements)
        pair = [elements[(first + d) % len(elements)] for d in (0, 1)]
        pair.sort(key=lambda e: e[1])
        out.append(spark_hash((pair[0][0], 8), (pair[1][0], 8)) & 0x7FFF)
    return out


def deduplicated(docs: list[tuple], length: int) -> dict:
    """For (id, text) in order: bytes, removed bytes, spans and digest of what stays."""
    seen, out = set(), {}
    for doc_id, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = bytes(gone).replace(b"\x00", b" ").split()
        out[doc_id] = (len(raw), sum(gone), len(runs), hashlib.sha256(kept).hexdigest())
    return out


def gram_set(text: str, n: int = 5) -> frozenset:
    words = (text or "").split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1 if words else 0)))


def near_copies(docs: list[tuple], limit: float = 0.8) -> dict:
    """For (id, text): the smallest id of its component, and how many it is linked to."""
    sets = {i: gram_set(t) for i, t in docs}
    ids, links, root = sorted(sets), defaultdict(int), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] == sets[b] or common >= limit * both:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in ids}


def normal(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def best_fit(sizes, marks, capacity):
    """Of the bins with room and without any of the marks the one with the least room, else a new one."""
    bins, out = [], []
    for size, mark in zip(sizes, marks):
        fitting = [(room, b) for b, (room, held) in enumerate(bins) if room >= size and not held & mark]
        b = min(fitting)[1] if fitting else len(bins)
        if not fitting:
            bins.append((capacity, frozenset()))
        bins[b] = (bins[b][0] - size, bins[b][1] | mark)
        out.append(b)
    return out
