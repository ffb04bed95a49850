"""Removing what a corpus repeats: every byte of a long string that has also stood earlier.

Which strings can meet. In each run of ``LENGTH`` bytes the q-gram of the smallest hash is its anchor; equal
runs have equal anchors at equal places. Anchors that occur once in the corpus are done. The runs
that have an occurrence as their anchor follow each other; the stretch they cover is its context.
If an equal context came earlier, all its runs did. What is left is one context per anchor and
content, and only anchors with several different ones need more.

How they are compared. Contexts of an anchor go to one shard. A shard is one string, of which a
suffix array is built by induced sorting: suffixes are classified, the leftmost-smaller ones sorted by
their substrings and then as a string of their own, and all others induced from them, bucket by
bucket. Neighbours in it that agree in ``LENGTH`` bytes, taken back to text order, are the repeated runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import saved, shipped
from pulseline.llm.order import distinct
from pulseline.llm.rolling import Stretches, mixed

# Bytes of a repeated string, and of the q-gram that anchors it.
LENGTH, Q = 100, 20
# Bytes of texts looked at together, and about the bytes of a shard.
TOGETHER, SHARD = 200_000, 1_000_000
# Contexts of one anchor that a shard takes; runs of anchors with more are compared by hash.
CROWD = 50_000
MOST = np.iinfo(np.uint64).max


def sliding(v: np.ndarray, w: int, fn: np.ufunc, neutral) -> np.ndarray:
    """``fn`` (minimum or maximum) over each run of ``w`` values, from prefixes and suffixes of blocks."""
    n = len(v)
    blocks = np.r_[v, np.full(-n % w, neutral, v.dtype)].reshape(-1, w)
    before = fn.accumulate(blocks, axis=1).ravel()
    after = fn.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return fn(after[: n - w + 1], before[w - 1 : n])


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, q: int = Q):
    """Anchors in texts that lie one after the other: hash, content, text, place, and context's ends.

    A context is [place - left, place + right): the runs of which the place is the anchor. If
    hashes tie, a run may have several anchors.
    """
    w = length - q + 1
    if len(raw) < length:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none, none, none
    hashed = Stretches(raw)
    i = np.arange(len(raw) - q + 1)
    v = hashed(i, i + q)
    least = sliding(v, w, np.minimum, MOST)
    # A run that crosses the border of two texts is no run.
    text = np.searchsorted(ends, np.arange(len(least)), side="right")
    inside = ends[text] >= np.arange(len(least)) + length
    least = np.where(inside, least, np.uint64(0))
    edge = np.zeros(w - 1, dtype=np.uint64)
    most = sliding(np.r_[edge, least, edge], w, np.maximum, np.uint64(0))
    place = np.flatnonzero(v == most)
    # The first and the last run with this value that holds the place: stretches of equal ``least``.
    change = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    until = np.r_[change[1:], len(least)]
    run = np.searchsorted(change, np.minimum(place, len(least) - 1), side="right") - 1
    lowest = np.maximum(place - w + 1, 0)
    for _ in range(w):
        on = (least[change[run]] != v[place]) & (change[run] > lowest)
        if not on.any():
            break
        run = np.where(on, run - 1, run)
    first = np.maximum(change[run], lowest)
    last = np.minimum(until[run] - 1, place)
    good = (least[change[run]] == v[place]) & (last >= first)
    place, first, last = place[good], first[good], last[good]
    a, b = first, last + length
    content = mixed(hashed(a, b) + (place - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own = np.searchsorted(ends, place, side="right")
    return v[place], content.view(np.int64), own, place - starts[own], place - a, b - place


def _batches(found: pd.Series, most: int = TOGETHER) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, a few at a time, with the place of the first."""
    some, size, begin = [], 0, 0
    for k, text in enumerate(found):
        raw = text.encode("utf-8", "surrogatepass")
        if some and size + len(raw) > most:
            yield begin, some
            some, size, begin = [], 0, k
        some.append(raw)
        size += len(raw)
    if some:
        yield begin, some


def _classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix whether it is smaller than the next one, and the leftmost ones of such runs."""
    differs = np.flatnonzero(t[:-1] != t[1:])
    smaller = np.zeros(len(t), dtype=bool)
    # A suffix within a run of one symbol is like the run's last.
    up = t[differs] < t[differs + 1]
    lengths = np.diff(np.r_[-1, differs])
    smaller[: differs[-1] + 1 if len(differs) else 0] = np.repeat(up, lengths)
    smaller[-1] = True
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, leftmost


def _induce(t: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in (some) order: larger ones, then smaller."""
    order = np.argsort(t[leftmost], kind="stable")
    given, bounds = leftmost[order], np.searchsorted(t[leftmost][order], np.arange(symbols + 1))
    large: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def deal(found: np.ndarray, to: list[list[np.ndarray]], own: int) -> np.ndarray:
        """Append suffixes to their symbols' buckets, in order; the own bucket's are returned."""
        symbol = t[found]
        by = np.argsort(symbol, kind="stable")
        found, symbol = found[by], symbol[by]
        cuts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]]) if len(found) else []
        stay = found[:0]
        for a, b in zip(cuts, np.r_[cuts[1:], len(found)] if len(cuts) else []):
            if symbol[a] == own:
                stay = found[a:b]
            to[symbol[a]].append(found[a:b])
        return stay

    for c in range(symbols):
        wave = np.concatenate(large[c]) if large[c] else given[:0]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = deal(before[~smaller[before]], large, c)
        own = given[bounds[c] : bounds[c + 1]]
        before = own[own > 0] - 1
        deal(before[~smaller[before]], large, -1)
    large_of = [np.concatenate(x) if x else given[:0] for x in large]
    small: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    for c in range(symbols - 1, -1, -1):
        wave = np.concatenate(small[c]) if small[c] else given[:0]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = deal(before[smaller[before]], small, c)
        own = large_of[c][::-1]
        before = own[own > 0] - 1
        deal(before[smaller[before]], small, -1)
    # The last suffix has nothing after it that could induce it.
    parts = [np.array([len(t) - 1])]
    for c in range(symbols):
        parts.append(large_of[c])
        if small[c]:
            parts.append(np.concatenate(small[c])[::-1])
    return np.concatenate(parts)


def _string_order(names: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes of a string of names, as far as their first ``reach`` names tell.

    Its alphabet is as large as the string, so it is sorted by doubling: ranks of twice as many names
    from the ranks at both halves. Suffixes alike in ``reach`` names keep the order of their places.
    """
    rank, n, step = names.astype(np.int64), len(names), 1
    while step < reach:
        later = np.zeros(n, dtype=np.int64)
        later[: n - step] = rank[step:] + 1
        key = rank * np.int64(n + 2) + later
        order = np.argsort(key, kind="stable")
        changed = key[order][1:] != key[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.r_[0, np.cumsum(changed)]
        step *= 2
        if changed.all():
            break
    return np.argsort(rank, kind="stable")


def suffix_order(t: np.ndarray, symbols: int, length: int = LENGTH) -> np.ndarray:
    """The suffixes of ``t`` in the order of their first ``length`` symbols.

    ``t`` ends with the symbol 0, which is nowhere else. Suffixes with as many symbols in common
    stand together, in any order.
    """
    smaller, leftmost = _classify(t)
    if len(leftmost) < 2:
        return _induce(t, smaller, leftmost, symbols)
    # Sorted by their substrings, each up to the next leftmost-smaller suffix ..
    rough = _induce(t, smaller, leftmost, symbols)
    number = np.full(len(t), -1, dtype=np.int64)
    number[leftmost] = np.arange(len(leftmost))
    by_substring = number[rough]
    by_substring = by_substring[by_substring >= 0]
    after = np.minimum(np.r_[leftmost[1:], len(t) - 1] + 1, len(t))
    hashed = Stretches(t)(leftmost, after) + (after - leftmost).astype(np.uint64)
    new = np.r_[True, hashed[by_substring][1:] != hashed[by_substring][:-1]]
    names = np.empty(len(leftmost), dtype=np.int64)
    names[by_substring] = np.cumsum(new) - 1
    # .. and then by the string that the names of the substrings form. Each has two symbols at least.
    order = by_substring if new.all() else _string_order(names, length // 2 + 1)
    return _induce(t, smaller, leftmost[order], symbols)


def repeated_runs(contexts: list[bytes], owner: np.ndarray, start: np.ndarray, length: int = LENGTH):
    """Runs of contexts that stand earlier in others, as (owner, first byte, after the last) arrays.

    ``owner`` and ``start`` say in which text, and where in it, a context stands; the smaller come first.
    """
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    raw = np.frombuffer(b"\x00".join(contexts) + b"\x00", dtype=np.uint8)
    t = raw.astype(np.int64) + 2
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    t[begin + sizes] = 1
    t = np.r_[t, 0]
    which = np.repeat(np.arange(len(contexts)), sizes + 1)
    offset = np.arange(len(raw)) - begin[which]
    order = suffix_order(t, 258, length)
    order = order[order < len(raw)]
    order = order[offset[order] + length <= sizes[which[order]]]
    if len(order) < 2:
        return owner[:0], start[:0], start[:0]
    hashed = Stretches(raw)(order, order + length)
    shared = np.r_[False, hashed[1:] == hashed[:-1]]
    # Earliest of each family of equal runs, by text and then by place.
    ids, rank = np.unique(owner, return_inverse=True)
    place = start[which[order]] + offset[order]
    span = np.int64(start.max() + sizes.max() + 1)
    key = rank[which[order]].astype(np.int64) * span + place
    heads = np.flatnonzero(~shared)
    earliest = np.repeat(np.minimum.reduceat(key, heads), np.diff(np.r_[heads, len(key)]))
    later = np.unique(key[key > earliest])
    if not len(later):
        return owner[:0], start[:0], start[:0]
    head = np.r_[True, np.diff(later) > 1]
    first, last = later[head], later[np.r_[np.flatnonzero(head)[1:] - 1, len(later) - 1]]
    return ids[first // span], first % span, last % span + length


def _bits(length: int) -> int:
    """Bits for each end of a context, which is at most ``length`` bytes from its anchor; a place takes 31."""
    bits = max(8, length.bit_length())
    if bits > 16:
        raise ValueError("length must be below 65,536")
    return bits


def _anchor_rows(length: int, q: int):
    bits = _bits(length)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            uid = batch["uid"].to_numpy(dtype=np.int64)
            for begin, some in _batches(batch["text"]):
                ends = np.cumsum([len(x) for x in some])
                starts = np.r_[0, ends[:-1]]
                raw = np.frombuffer(b"".join(some), dtype=np.uint8)
                h, content, own, place, left, right = anchors(raw, starts, ends, length, q)
                if len(h):
                    yield pd.DataFrame(
                        {
                            "h": h.view(np.int64),
                            "c": content,
                            "uid": uid[begin + own],
                            "at": place << 2 * bits | left << bits | right,
                        }
                    )

    return look


def repeated_spans(rows: DataFrame, length: int = LENGTH, q: int = Q, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """``uid``, ``start``, ``end``: stretches of bytes of ``rows`` (``uid``, ``text``) that repeat earlier ones."""
    for name in ("rolling", "suffixes"):
        shipped(f"pulseline.llm.{name}")
    # Contexts of an anchor have its hash in common, so the content alone, in full, tells them apart.
    found = rows.mapInPandas(_anchor_rows(length, q), "h bigint, c bigint, uid bigint, at bigint")
    several = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    found = saved(found.join(several, "h"), "anchors")
    firsts = found.groupBy("h", "c").agg(F.min(F.struct("uid", "at")).alias("first"), F.count("*").alias("n"))
    bits, end = _bits(length), (1 << _bits(length)) - 1
    place, left, right = F.expr(f"at >> {2 * bits}"), F.expr(f"at >> {bits} & {end}"), F.expr(f"at & {end}")
    span = [(place - left).alias("start"), (place + right).alias("end")]
    again = found.join(firsts.where("n > 1").select("h", "c", "first"), ["h", "c"])
    again = again.where(F.struct("uid", "at") != F.col("first")).select("uid", *span)

    # Anchors with several contexts; one occurrence of each context is left.
    contents = firsts.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    open_ = saved(
        firsts.select("h", "first.uid", "first.at").join(contents, "h").select("h", "k", "uid", *span, "at"), "contexts"
    )
    size = open_.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("bigint")).first()[0]
    shards = max(1, -(-size // shard))
    wanted = open_.groupBy("uid").agg(F.collect_list(F.struct("h", "k", "at")).alias("open"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for uid, text, some in zip(batch["uid"], batch["text"], batch["open"]):
                raw = text.encode("utf-8", "surrogatepass")
                for x in some:
                    at = x["at"]
                    a, b = (at >> 2 * bits) - (at >> bits & end), (at >> 2 * bits) + (at & end)
                    out.append((x["h"], x["k"], uid, a, raw[a:b]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["h", "k", "uid", "start", "context"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["h", "k", "uid", "start", "context"])

    contexts = rows.join(wanted, "uid").mapInPandas(cut, "h bigint, k bigint, uid bigint, start bigint, context binary")

    def sort(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        uid, start, end = repeated_runs(
            frame["context"].tolist(), frame["uid"].to_numpy(np.int64), frame["start"].to_numpy(np.int64), length
        )
        return pd.DataFrame({"uid": uid, "start": start, "end": end})

    shape = "uid bigint, start bigint, end bigint"
    by_shard = contexts.where(F.col("k") <= crowd).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    spans = by_shard.groupBy("shard").applyInPandas(sort, shape)
    if open_.where(F.col("k") > crowd).limit(1).count():
        # An anchor that stands in too many contexts for one shard: its runs one by one, by their hashes.
        offset = F.explode(F.sequence(F.lit(0), F.octet_length("context") - length))
        crowded = contexts.where(F.col("k") > crowd).select("uid", "start", "context", offset.alias("o"))
        run = F.expr(f"substring(context, o + 1, {length})")
        runs = crowded.select("uid", (F.col("start") + F.col("o")).alias("start"), F.xxhash64(run).alias("r"), F.crc32(run).alias("s"))
        first = runs.groupBy("r", "s").agg(F.min(F.struct("uid", "start")).alias("first"), F.count("*").alias("n"))
        later = runs.join(first.where("n > 1"), ["r", "s"]).where(F.struct("uid", "start") != F.col("first"))
        spans = spans.unionByName(later.select("uid", "start", (F.col("start") + length).alias("end")))
    return again.unionByName(saved(spans, "spans"))


def merged(starts, ends) -> list[tuple[int, int]]:
    """Maximal stretches that the given ones cover; stretches that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to the characters all of whose bytes they cover."""
    inner = lambda x: x < len(raw) and raw[x] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while a < b and inner(a):
            a += 1
        while b > a and inner(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH, q: int = Q, shard: int = SHARD, crowd: int = CROWD, carry: list[str] | None = None) -> DataFrame:
    """What is left of every whole text when bytes covered by a string that also starts earlier go.

    Rows: ``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (removed stretches of bytes, which do not
    touch), ``kept`` (the other bytes) and ``kept_text`` (the same, but a character goes only if all
    its bytes do), and ``rest``, a row of the columns named in ``carry``. Strings of ``length`` bytes are compared as the input has them, across texts too; earlier
    means a smaller ``doc_id``, or the same document and an earlier start. Matches never cross texts.
    A NULL text is empty. Rows with the same id and text are one document, and get the same result;
    texts that share an id follow each other by a hash of the text; NULL ids come first.
    """
    rows, order = distinct(docs, carry)
    spans = repeated_spans(rows.select("uid", "text"), length, q, shard, crowd)
    by_text = spans.groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("found"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["uid", "n_bytes", "n_removed", "spans", "kept", "kept_text", "rest"]
        for batch in batches:
            out, size = [], 0
            for uid, text, found, rest in zip(batch["uid"], batch["text"], batch["found"], batch["rest"]):
                raw = text.encode("utf-8", "surrogatepass")
                gone = merged([x["start"] for x in found], [x["end"] for x in found]) if found is not None else []
                kept = _kept(raw, gone)
                whole = _kept(raw, _whole_characters(raw, gone)).decode("utf-8", "surrogatepass")
                out.append((uid, len(raw), len(raw) - len(kept), [{"start": a, "end": b} for a, b in gone], kept, whole, rest))
                size += len(raw)
                if size > SHARD:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    shape = "uid bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>"
    rest = rows.schema["rest"].dataType.simpleString()
    done = rows.join(by_text, "uid", "left").mapInPandas(cut, f"{shape}, kept binary, kept_text string, rest {rest}")
    if order is None:
        return done.withColumnRenamed("uid", "doc_id")
    ids = order.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    ids = ids.select("uid", F.when(F.col("has_id"), F.col("id")).alias("doc_id"))
    return ids.join(done, "uid").drop("uid")


def digests(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
