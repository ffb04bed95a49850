"""Counting byte-level BPE tokens, by merging many pre-tokens at a time.

Texts are cut into pre-tokens by the tokenizer's pattern. The distinct new pre-tokens of a batch
are one flat array of symbols. In each round every pre-token has all occurrences of its own
lowest-ranked pair merged, all pre-tokens at the same time, until no pair is left that merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import n_bytes, shipped, texts

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Code points that the regex module counts as letters or digits and the tokenizer
# library, with older character tables, does not (first, last; hexadecimal).
NEWER = """
558 558, 58b 58c, 88f 88f, c5c c5c, cdc cdc, 208f 208f, 209d 209f, a7ce a7cf, a7d2 a7d2, a7d4 a7d4,
a7dd a7dd, a7e2 a7e2, a7f1 a7f1, ab6c ab6d, 107bb 107bf, 10940 10959, 10ec5 10ec7, 10ed9 10eee,
11b0a 11b0a, 11db0 11ddb, 11de0 11de9, 11df1 11df1, 1246f 1246f, 12475 1247f, 12550 12686,
16ea0 16eb8, 16ebb 16ed3, 16ff2 16ff6, 187f8 187ff, 18cd6 18cda, 18d09 18d20, 18d80 18df2,
18e00 19191, 191a0 191d2, 1b123 1b128, 1b168 1b168, 1d6a6 1d6a6, 1df1f 1df24, 1df2b 1df81,
1df90 1df96, 1dfcd 1dfff, 1e6c0 1e6de, 1e6e0 1e6e2, 1e6e4 1e6e5, 1e6e7 1e6ed, 1e6f0 1e6f4,
1e6fe 1e6ff, 2b73a 2b73f, 2b81e 2b81e, 2cea2 2cead, 323b0 33479, 3d000 3fc3f
"""

# Pre-tokens looked at together, characters of text taken together, and remembered pre-tokens.
CHUNK, BATCH_CHARS, REMEMBERED = 1 << 17, 1 << 22, 400_000
NO_RANK = np.iinfo(np.int64).max


def vocabulary(path: str) -> dict:
    """Merges of a byte-level BPE file as arrays, and the strings that are tokens by themselves."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    # Bytes that print stand for themselves, the others for the code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    left, right, made = (
        np.array([vocab[x] for x in column], dtype=np.int64)
        for column in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])
    )
    keys = left << 32 | right
    order = np.argsort(keys, kind="stable")
    return {
        "bytes": np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64),
        "keys": keys[order],
        "ranks": order.astype(np.int64),
        "made": made,
        "special": [t["content"] for t in spec.get("added_tokens", []) if t["content"]],
    }


class Counter:
    """Token counts of texts; one per task."""

    def __init__(self, vocab: dict, pattern: str = PATTERN):
        import regex

        self.vocab, self.known = vocab, {}
        self.pattern = regex.compile(pattern)
        newer = "".join(
            f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in (x.split() for x in NEWER.split(","))
        )
        self.newer = regex.compile(f"[{newer}]")
        older = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])")
        older = older.replace(r"\p{L}+", rf"(?:(?![{newer}])\p{{L}})+").replace(
            r"\p{N}+", rf"(?:(?![{newer}])\p{{N}})+"
        )
        self.older = regex.compile(older)
        special = "|".join(regex.escape(s) for s in sorted(vocab["special"], key=len, reverse=True))
        self.special = regex.compile(special) if special else None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, wanted = self.vocab["keys"], left << 32 | right
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return np.where(keys[at] == wanted, self.vocab["ranks"][at], NO_RANK) if len(keys) else np.full(len(left), NO_RANK)

    def merged(self, words: list[bytes]) -> np.ndarray:
        """How many symbols of each word survive all merges."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        counts = lengths.copy()
        symbols = self.vocab["bytes"][np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        if not len(symbols):
            return counts
        ranks = np.full(len(symbols), NO_RANK)  # of the pair that begins at each symbol
        inner = np.flatnonzero(word[:-1] == word[1:])
        ranks[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            lowest = np.minimum.reduceat(ranks, first)
            counts[word[first]] = size
            # Words without a pair to merge are done.
            alive = np.repeat(lowest < NO_RANK, size)
            if not alive.all():
                symbols, word, ranks = symbols[alive], word[alive], ranks[alive]
                size, lowest = size[lowest < NO_RANK], lowest[lowest < NO_RANK]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(lowest, size)
            # In a run of hits (one symbol repeated) every second one merges, from the left.
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():
                starts = np.r_[True, np.diff(at) != 1]
                run = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.vocab["made"][ranks[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            changed = np.unique(np.r_[moved, np.maximum(moved - 1, 0)])
            ranks[changed] = NO_RANK
            changed = changed[changed < len(word) - 1]
            changed = changed[word[changed] == word[changed + 1]]
            ranks[changed] = self._ranks(symbols[changed], symbols[changed + 1])
        return counts

    def _learn(self, new: set[str]) -> None:
        words = list(new)
        for i in range(0, len(words), CHUNK):
            part = words[i : i + CHUNK]
            self.known.update(zip(part, self.merged([w.encode("utf-8", "surrogatepass") for w in part]).tolist()))

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in bounded lists."""
        pattern = self.older if self.newer.search(text) else self.pattern
        if len(text) <= BATCH_CHARS:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, CHUNK)):
            yield part

    def count(self, batch: list[str]) -> list[int]:
        totals, waiting, chars = [0] * len(batch), [], 0

        def settle() -> None:
            nonlocal waiting, chars
            if new := set().union(*(p for _, p in waiting)).difference(self.known):
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                    new = set().union(*(p for _, p in waiting))
                self._learn(new)
            for k, part in waiting:
                totals[k] += sum(map(self.known.__getitem__, part))
            waiting, chars = [], 0

        for k, text in enumerate(batch):
            parts = [text]
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                totals[k] += len(parts) - 1  # a special string is one token
            for own in parts:
                for piece in self._pieces(own):
                    waiting.append((k, piece))
                    chars += sum(map(len, piece)) if len(own) > BATCH_CHARS else len(own)
                    if chars > BATCH_CHARS:
                        settle()
        settle()
        return totals


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, pattern: str = PATTERN) -> DataFrame:
    """Tokens of every whole text, as the tokenizer in the file ``tokenizer`` would give them.

    One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``. A NULL text is
    empty and has no tokens. Special strings inside a text are one token each. Repeated rows stay.
    The file is read once, on the driver; its merges are bounded by the vocabulary and go with the task.
    """
    shipped(__name__)
    vocab = vocabulary(tokenizer)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(vocab, pattern)
        for batch in batches:
            yield pd.Series(counter.count(batch.tolist()), dtype="int64")

    counted = texts(docs).select("doc_id", n_bytes(F.col("text")).alias("n_bytes"), count("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
