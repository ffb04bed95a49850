"""Finding passages of benchmark items in documents, up to a budget of edits.

Items are cut into short windows that start every few characters, so that any passage a little longer
than a window holds a whole one, wherever it is cut. If a text holds a window of m characters with at most k
edits, the two share at least m - q + 1 - kq of the window's q-grams (the q-gram lemma), and all of
them lie on k + 1 neighbouring diagonals (place in the text minus place in the item). So shared
q-grams are counted per window and diagonal band; bands overlap by half, and one of them holds all
k + 1 diagonals. Places of items are indexed once, whatever the number of windows over them; only
the places that lie dense enough in a band are dealt to their windows. Only where a count reaches the bound, a banded alignment counts the edits.

Items too short for edits are looked for as they are, between word borders, by a hash of their length.

Texts are compared by letters and digits in lower case, with single spaces between.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import shipped, texts

SPACE = 32
# Bits of the table that says quickly whether a q-gram is in any item.
SIEVE_BITS = 22
# Characters of text looked through together, and windows aligned together.
TOGETHER, ALIGNED = 1 << 20, 1 << 14
MATCHES = "doc_id bigint, item_id bigint, edits int, n_windows int, matched_chars int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rules:
    """What counts as a match: characters per window and between windows, and edits per character.

    A passage of ``window + step - 1`` characters holds a whole window, so it is found with as many
    edits as a window may have. The step is below that number: a verbatim passage may even be
    shorter than a window by ``edits``, as the rest of the window counts as edits.
    """

    window: int = 64
    step: int = 5
    q: int = 8
    budget: float = 0.1
    # Items with fewer characters are looked for without edits, between word borders.
    least: int = 30

    def edits(self, m: int) -> int:
        """Edits allowed for a window; never so many that the lemma says nothing."""
        return max(0, min(int(self.budget * m), (m - self.q) // self.q))

    def shared(self, m: int) -> int:
        return m - self.q + 1 - self.edits(m) * self.q


_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point, its lower case if it is a letter or digit, else a space."""
    if not _FOLD:
        table = np.full(0x110000, SPACE, dtype=np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalnum():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The compared form of a text as code points, and the place in the text of each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = _fold()[np.minimum(points, 0x10FFFF)]
    space = folded == SPACE
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    if len(at) and space[at[0]]:
        at = at[1:]
    if len(at) and space[at[-1]]:
        at = at[:-1]
    return folded[at], at


# Letters written without spaces between words (Thai to Myanmar, Khmer, kana, Han), from and to; each is a word.
UNSPACED = np.array(
    [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF),
     (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
)


def borders(points: np.ndarray) -> np.ndarray:
    """For each place from 0 to the length whether a word may begin or end there."""
    apart = (points == SPACE) | (points == 0)
    apart |= np.searchsorted(UNSPACED[:, 0], points, side="right") > np.searchsorted(UNSPACED[:, 1], points)
    return np.r_[True, apart[1:] | apart[:-1], True] if len(points) else np.ones(1, dtype=bool)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A mixed 64-bit number for each run of q code points."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    # Runs of 1, 2, 4 .. code points, put together to runs of q.
    one, made, length = points.astype(np.uint64), None, 0
    power, width = 0x9E3779B97F4A7C15, 1
    while width <= q:
        if q & width:
            if made is None:
                made = one
            else:
                rest = one[length:]
                made = made[: len(rest)] * np.uint64(power) + rest
            length += width
        one = one[:-width] * np.uint64(power) + one[width:]
        power, width = power * power % (1 << 64), width * 2
    made = made[:n].copy()
    made ^= made >> np.uint64(31)
    made *= np.uint64(0xBF58476D1CE4E5B9)
    made ^= made >> np.uint64(29)
    return made


@dataclass
class Index:
    """The windows of a block of items, and where each q-gram stands in them."""

    rules: Rules
    items: list = field(default_factory=list)

    def build(self, rows: list[tuple[int, str]]) -> Index:
        rules, texts_, starts, ends, owner = self.rules, [], [], [], []
        # Of each q-gram: itself, its place, and the windows that hold it (from, up to).
        keys, places, low, high = [], [], [], []
        at = 0
        # Of short items, by length: the hash, and the places in ``items`` with their characters.
        short: dict[int, dict[int, list]] = {}
        for item_id, text in rows:
            points, _ = normal(text or "")
            m = len(points)
            if m < max(rules.least, rules.q):
                if m:
                    short.setdefault(m, {}).setdefault(int(grams(points, m)[0]), []).append((len(self.items), points))
                    self.items.append(item_id)
                continue
            first = range(0, max(m - rules.window, 0) + 1, rules.step)
            own = sorted({*first, max(m - rules.window, 0)})
            g = grams(points, rules.q)
            place = np.arange(len(g))
            keys.append(g)
            places.append(at + place)
            low.append(len(owner) + np.searchsorted(own, place + rules.q - rules.window))
            high.append(len(owner) + np.searchsorted(own, place, side="right"))
            starts += [at + s for s in own]
            ends += [at + min(s + rules.window, m) for s in own]
            owner += [len(self.items)] * len(own)
            self.items.append(item_id)
            texts_.append(points)
            # A gap as wide as a window keeps items on diagonals of their own.
            texts_.append(np.zeros(rules.window, dtype=np.uint32))
            at += m + rules.window
        self.text = np.concatenate(texts_) if texts_ else np.zeros(0, dtype=np.uint32)
        self.start, self.end, self.owner = (np.array(x, dtype=np.int64) for x in (starts, ends, owner))
        length = self.end - self.start
        self.budget = np.array([rules.edits(m) for m in length], dtype=np.int64)
        self.bound = np.array([rules.shared(m) for m in length], dtype=np.int64)
        self.band = int(self.budget.max(initial=0)) + 1
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, dtype=kind)
        keys, places, low, high = join(keys, np.uint64), join(places, np.int64), join(low, np.int32), join(high, np.int32)
        order = np.argsort(keys, kind="stable")
        self.places, self.low, self.high = places[order], low[order], high[order]
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.short = {m: (np.array(sorted(own), dtype=np.uint64), own) for m, own in short.items()}
        self.sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.sieve[self.keys >> np.uint64(64 - SIEVE_BITS)] = True
        return self

    def verbatim(self, points: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in ``items``, first, after last place in the text) of the short items."""
        if not self.short:
            return
        border = borders(points)
        for m, (hashes, own) in self.short.items():
            g = grams(points, m)
            at = np.flatnonzero(border[: len(g)] & border[m : m + len(g)])
            found = np.minimum(np.searchsorted(hashes, g[at]), len(hashes) - 1)
            for a in at[hashes[found] == g[at]].tolist():
                for k, item in own[int(g[a])]:
                    if np.array_equal(points[a : a + m], item):
                        yield k, a, a + m

    def candidates(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows, and the lowest diagonal of the band in which they share enough q-grams."""
        none = np.zeros(0, dtype=np.int64)
        g = grams(points, self.rules.q)
        at = np.flatnonzero(self.sieve[g >> np.uint64(64 - SIEVE_BITS)]) if len(g) and len(self.keys) else none
        if not len(at):
            return none, none
        found = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        true = self.keys[found] == g[at]
        at, found = at[true], found[true]
        # A window's q-grams lie within so many places; fewer hits there than any bound are no match.
        if len(at):
            reach = self.rules.window + self.band
            near = np.searchsorted(at, at + reach) - np.arange(len(at))
            last = np.maximum.accumulate(np.where(near >= self.bound.min(), at + reach, -1))
            inside = at < last
            at, found = at[inside], found[inside]
        if not len(at):
            return none, none
        times = self.count[found]
        begin = np.repeat(self.first[found] - np.r_[0, np.cumsum(times)[:-1]], times)
        entry = begin + np.arange(times.sum())
        place, diagonal = self.places[entry], np.repeat(at, times) - self.places[entry]
        bands = -(-(len(points) + len(self.text)) // self.band) + 4
        low = (diagonal + len(self.text)) // self.band + 1
        # Distinct places of the item in each band count, not how often the text repeats one.
        size = np.int64(len(self.text) + self.rules.window)
        key = np.concatenate([low, low - 1]) * size + np.concatenate([place, place])
        order = np.argsort(key)
        order = order[np.r_[True, np.diff(key[order]) > 0]]
        key, entry = key[order], entry[order % len(entry)]
        # Only where so many of them lie within a window's length can a window reach its bound.
        reach = self.rules.window - self.rules.q
        near = np.searchsorted(key, key + reach, side="right") - np.arange(len(key))
        last = np.maximum.accumulate(np.where(near >= self.bound[self.low[entry]], key + reach, -1))
        key, entry = key[key <= last], entry[key <= last]
        times = (self.high[entry] - self.low[entry]).astype(np.int64)
        begin = np.repeat(self.low[entry] - np.r_[0, np.cumsum(times)[:-1]][: len(times)], times)
        window = begin + np.arange(times.sum())
        key, shared = np.unique(window * bands + np.repeat(key // size, times), return_counts=True)
        key = key[shared >= self.bound[key // bands]]
        return key // bands, (key % bands - 1) * self.band - len(self.text)

    def aligned(self, points: np.ndarray, window: np.ndarray, low: np.ndarray) -> list[tuple]:
        """(window, edits, first, after last place in the text) of the candidates within their budget."""
        if not len(window):
            return []
        m, width = self.end[window] - self.start[window], 2 * self.band
        longest = int(m.max())
        row = np.arange(longest)
        pattern = self.text[np.minimum(self.start[window][:, None] + row, len(self.text) - 1)]
        start = self.start[window] + low  # the text place of the window's first character, band's low end
        across = np.arange(width, dtype=np.int64)
        # Cost and beginning in one number: cheaper first, then the earlier beginning.
        unit = np.int64(1 << 20)
        value = np.tile(across, (len(window), 1))
        result = np.full(len(window), np.iinfo(np.int64).max)
        where = np.zeros(len(window), dtype=np.int64)
        far = unit << np.int64(20)
        for r in range(longest):
            place = start[:, None] + r + across
            inside = (place >= 0) & (place < len(points))
            letters = points[np.clip(place, 0, len(points) - 1)]
            step = value + np.where(inside & (letters == pattern[:, r : r + 1]), 0, unit)
            step = np.where(inside, step, far)
            up = np.concatenate([value[:, 1:], np.full((len(window), 1), far)], axis=1) + unit
            value = np.minimum(step, up)
            value = np.minimum.accumulate(value - across * unit, axis=1) + across * unit
            ended = m == r + 1
            if ended.any():
                result[ended] = value[ended].min(1)
                where[ended] = value[ended].argmin(1)
        edits = result // unit
        good = edits <= self.budget[window]
        first = start + result % unit
        after = start + where + m
        return [
            (int(window[i]), int(edits[i]), max(int(first[i]), 0), min(int(after[i]), len(points)))
            for i in np.flatnonzero(good)
        ]

    def matches(self, batch: list[str]) -> Iterator[tuple]:
        """(place in the batch, item, edits, windows, characters, spans) for each item found in a text."""
        if not self.items:
            return
        # Texts lie one after the other, a window's width apart, so that a few calls serve many.
        gap = np.zeros(self.rules.window, dtype=np.uint32)
        begin = 0
        while begin < len(batch):
            parts, maps, starts, chars, end = [], [], [], 0, begin
            while end < len(batch) and (end == begin or chars + len(batch[end]) <= TOGETHER):
                points, at = normal(batch[end])
                starts.append(chars)
                parts += [points, gap]
                maps.append(at)
                chars += len(points) + len(gap)
                end += 1
            found: dict[tuple[int, int], list[tuple]] = {}
            points = np.concatenate(parts)
            window, low = self.candidates(points)
            some = [slice(a, a + ALIGNED) for a in range(0, len(window), ALIGNED)]
            near = chain.from_iterable(self.aligned(points, window[x], low[x]) for x in some)
            whole = ((owner, 0, first, after, -1) for owner, first, after in self.verbatim(points))
            for owner, edits, first, after, w in chain(((int(self.owner[x[0]]), *x[1:], x[0]) for x in near), whole):
                k = int(np.searchsorted(starts, (first + after) // 2, side="right")) - 1
                first, after = max(first - starts[k], 0), min(after - starts[k], len(maps[k]))
                if after > first:
                    own = (int(maps[k][first]), int(maps[k][after - 1]) + 1, edits, w)
                    found.setdefault((k, owner), []).append(own)
            for (k, owner), own in found.items():
                spans: list[list[int]] = []
                for first, after, _, _ in sorted(own):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], after)
                    else:
                        spans.append([first, after])
                yield (
                    begin + k,
                    self.items[owner],
                    min(x[2] for x in own),
                    len({x[3] for x in own}),
                    sum(b - a for a, b in spans),
                    [{"start": a, "end": b} for a, b in spans],
                )
            begin = end


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The items (id, text) in blocks of about ``block_chars`` characters; one empty block if there are none."""
    shipped(__name__)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text"))
    items = items.where(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [(r["item_id"], r["text"]) for r in items.where(block == b).orderBy("item_id", "text").collect()]


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), block_chars: int = 2_000_000
) -> DataFrame:
    """Benchmark items that each whole text holds a window of, within the edit budget.

    One row per document and item: ``doc_id``, ``item_id``, the fewest ``edits`` of a matched window,
    ``n_windows`` matched, ``matched_chars`` and the merged ``spans`` of the text, in characters.
    A text without a match has no row. NULL and empty texts match nothing, nor do items that are NULL or
    without a letter or digit. Items shorter than ``rules.least`` compared characters match as they
    are, between word borders (any letter of a script without spaces is a word). Of items with the same
    id each is looked for, and a document may have a row for each. Repeated documents each get rows.

    Items go to the tasks in blocks of about ``block_chars`` characters, so a large benchmark takes
    more passes over the documents, not more memory.
    """
    out = None
    for own in _blocks(benchmark, block_chars):

        def look(batches: Iterator[pd.DataFrame], own=own) -> Iterator[pd.DataFrame]:
            index = Index(rules).build(own)
            names = ["doc_id", "item_id", "edits", "n_windows", "matched_chars", "spans"]
            for batch in batches:
                ids = batch["doc_id"].astype("Int64")
                found = [(ids.iloc[m[0]], *m[1:]) for m in index.matches(batch["text"].tolist())]
                if found:
                    frame = pd.DataFrame(found, columns=names)
                    yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

        part = texts(docs).mapInPandas(look, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(items: list[tuple], rules: Rules):
    """A function of text columns: whether a text matches none of the items."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(rules).build(items)
        for batch in batches:
            out = np.ones(len(batch), dtype=bool)
            out[[m[0] for m in index.matches(batch.tolist())]] = False
            yield pd.Series(out)

    return clean


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), block_chars: int = 2_000_000
) -> DataFrame:
    """The rows of ``docs``, as they are, whose texts match no item."""
    for own in _blocks(benchmark, block_chars):
        docs = docs.where(_clean(own, rules)(F.coalesce(docs["text"], F.lit(""))))
    return docs
