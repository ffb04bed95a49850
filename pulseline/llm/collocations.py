"""Phrases whose words keep company, mined with stripes.

A stripe is a prefix with an associative counter of the words that follow it. Tasks count stripes over
stretches of text, and stripes of one prefix are merged elementwise. The merged stripe holds all that is asked: its
entries are the counts of the prefix's extensions, and the largest entry tells what the prefix is subsumed by. On request
what follows rarely, or nothing, is counted under the empty word, so that the sum is the count of the prefix; the query does
without, as that count is an entry one length before.

Stripes are merged length by length. A phrase can only be frequent if the phrases without its last
and without its first word are; a filter of fixed size over the frequent ones of the length before, which may let
others pass but never holds a frequent one back, keeps the rest out of the stripes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseline.llm.common import saved, shipped
from pulseline.operators.skew import Budget, salted_join

# Bytes of text counted at once; bits of the filter (a power of two), 4 MB whatever the input.
CHUNK, FILTER_BITS = 4 << 20, 1 << 25
# A prefix with one in WIDE of all words (so at most WIDE prefixes of a length) has its stripe cut into PARTS.
WIDE, PARTS = 1_000, 64
# A-Z to a-z; the marks that end a piece to a newline, a tab to a space.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256)
)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
# A row holds the stripes of one stretch of text that go to the same bucket of the shuffle; the words of a
# stripe are one string, in which spaces part them.
STRIPES = "lang string, bucket int, stripes array<struct<prefix:string,part:int,words:string,counts:array<int>>>"


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def run_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a run that goes on with a word."""
    mixed = (before ^ word) * FACTOR
    return mixed ^ (mixed >> np.uint64(29))


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    size = np.uint64(FILTER_BITS - 1)
    return [(hashes >> np.uint64(s)) & size for s in (3, 33)]


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    hit = [(bits[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) for s in slots(hashes)]
    return (hit[0] & hit[1]).astype(bool)


def pieces(texts: list[bytes]) -> Iterator[bytes]:
    """Texts as lower-case pieces between newlines, joined or cut (at a newline) into stretches of about ``CHUNK``."""
    data = b"\n".join(texts).translate(PLAIN)
    at = 0
    while len(data) - at > CHUNK:
        cut = data.rfind(b"\n", at, at + CHUNK)
        cut = cut if cut > at else data.find(b"\n", at + CHUNK)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut + 1
    yield data[at:]


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key, by when they first come up, and where that is."""
    number, _ = pd.factorize(keys)
    return number, np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))


def _eight(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place on, as one number; what is beyond ``size`` bytes is zero."""
    every = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    held = np.clip(size, 0, 8)
    mask = np.where(held == 8, np.uint64(0), np.uint64(1) << (8 * np.minimum(held, 7)).astype(np.uint64)) - np.uint64(1)
    return every[np.minimum(at, len(every) - 1)] & mask


def coded(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of pieces between newlines as numbers, with -1 between pieces, and what each number stands for.

    Words of up to 16 bytes are told apart as two numbers of eight bytes, longer ones by a dictionary.
    """
    raw = np.frombuffer(data + b" " * 16, dtype=np.uint8)
    gap = (raw == 32) | (raw == 10)
    turns = np.diff(np.r_[True, gap].astype(np.int8))
    starts, ends = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), []
    breaks = raw[ends[:-1]] == 10
    more = np.flatnonzero(starts[1:] - ends[:-1] > 1)
    lines = np.flatnonzero(raw == 10)
    breaks[more] = np.searchsorted(lines, starts[1:][more]) > np.searchsorted(lines, ends[:-1][more])
    size = ends - starts
    low, high = _eight(raw, starts, size), _eight(raw, starts + 8, size - 8)
    # A word has no zero padding that is its own: its length is part of what tells it.
    name = run_hash(run_hash(run_hash(np.zeros_like(low), low), high), size.astype(np.uint64))
    number = np.zeros(len(starts), dtype=np.int64)
    short = np.flatnonzero(size <= 16)
    number[short], first = numbered(name[short])
    pick = short[first]
    if any((x[pick][number[short]] != x[short]).any() for x in (low, high, size)):
        short, pick = short[:0], pick[:0]  # two words have one hash: the dictionary tells all of them apart
    vocab = [data[a:b] for a, b in zip(starts[pick].tolist(), ends[pick].tolist())]
    known: dict[bytes, int] = {}
    rest = np.ones(len(starts), dtype=bool)
    rest[short] = False
    for i in np.flatnonzero(rest).tolist():
        number[i] = known.setdefault(data[starts[i] : ends[i]], len(vocab) + len(known))
    code = np.full(len(number) + int(breaks.sum()), -1, dtype=np.int64)
    code[np.arange(len(number)) + np.r_[0, np.cumsum(breaks)]] = number
    return code, [*vocab, *known]


def stripes_of(
    lang: str, data: bytes, length: int, bits: np.ndarray | None, wide: np.ndarray, buckets: int, totals: bool = True
) -> pa.RecordBatch | None:
    """The stripes of the prefixes of ``length - 1`` words in a stretch of text, as rows of ``STRIPES``."""
    code, vocab = coded(data)
    if not vocab:
        return None
    n, size = len(code), len(vocab)
    # A piece ends where the text does, so a phrase never runs over the end.
    code = np.r_[code, np.full(length, -1)]
    own = np.array([hash_of(w) for w in vocab], dtype=np.uint64)
    follows = code[length - 1 : n + length - 1]
    if bits is None:
        starts = np.flatnonzero(follows >= 0)  # the empty prefix stands before every word
        after = follows[starts]
    else:
        hashes, run, whole = own[code], np.full(n + 1, hash_of(lang.encode()), dtype=np.uint64), np.ones(n + 1, dtype=bool)
        for k in range(length - 1):
            run = run_hash(run, hashes[k : n + 1 + k])
            whole &= code[k : n + 1 + k] >= 0
        frequent = whole & passes(bits, run)
        starts = np.flatnonzero(frequent[:n] if totals else frequent[:n] & frequent[1:])
        after = np.where(frequent[starts + 1], follows[starts], -1)
    if not len(starts):
        return None
    # Prefixes are numbered; ``first`` is where each stands for the first time.
    prefix, first = np.zeros(len(starts), dtype=np.int64), np.zeros(1, dtype=np.int64)
    for k in range(length - 1):
        prefix, first = numbered(prefix * size + code[starts + k])
    named = run[starts[first]] if length > 1 else np.zeros(1, dtype=np.uint64)
    cut = np.isin(named, wide) | (length == 1)
    part = np.r_[own % np.uint64(PARTS), np.uint64(0)].astype(np.int64)[after] * cut[prefix]
    keys = (prefix * PARTS + part) * (size + 1) + after + 1
    entry, at = numbered(keys)
    ordered = np.argsort(keys[at])
    keys, counts = keys[at][ordered], np.bincount(entry)[ordered]
    rows, next_ = keys // (size + 1), keys % (size + 1)
    begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    which, parts = rows[begins] // PARTS, rows[begins] % PARTS
    spelled = pa.array([b"", *vocab]).cast(pa.string())
    at = starts[first][which]
    names = [spelled.take(pa.array(code[at + k] + 1)) for k in range(length - 1)]
    offsets = pa.array(np.r_[begins, len(rows)].astype(np.int32))
    stripes = pa.StructArray.from_arrays(
        [
            pc.binary_join_element_wise(*names, " ") if names else pa.array([""] * len(begins)),
            pa.array(parts.astype(np.int32)),
            pc.binary_join(pa.ListArray.from_arrays(offsets, spelled.take(pa.array(next_))), " "),
            pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
        ],
        ["prefix", "part", "words", "counts"],
    )
    bucket = (run_hash(named[which], parts.astype(np.uint64)) >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    dealt = pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(order)].astype(np.int32)), stripes.take(pa.array(order)))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(cuts)), pa.array(bucket[cuts].astype(np.int32)), dealt], ["lang", "bucket", "stripes"]
    )


def _broadcast(spark: SparkSession, frequent: DataFrame) -> object:
    """A filter that every phrase (``lang``, ``phrase``) of a table passes, as a broadcast of fixed size."""

    @F.pandas_udf("array<bigint>")
    def slots_of(lang: pd.Series, phrase: pd.Series) -> pd.Series:
        return pd.Series(phrase_slots(lang, phrase))

    found = frequent.select(F.explode(slots_of("lang", "phrase")).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    filled = found.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[filled["at"].to_numpy()] = filled["bits"].to_numpy()
    return spark.sparkContext.broadcast(bits.view(np.uint64))


def phrase_hash(lang: str, phrase: str) -> np.uint64:
    run = np.array([hash_of(lang.encode())], dtype=np.uint64)
    for word in phrase.split(" "):
        run = run_hash(run, np.array([hash_of(word.encode())], dtype=np.uint64))
    return run[0]


def phrase_slots(lang: pd.Series, phrase: pd.Series) -> list:
    words = [p.encode().split(b" ") for p in phrase]
    run = np.array([hash_of(x.encode()) for x in lang], dtype=np.uint64)
    for k in range(max(map(len, words), default=0)):
        longer = np.array([hash_of(w[k]) if k < len(w) else 0 for w in words], dtype=np.uint64)
        run = np.where([k < len(w) for w in words], run_hash(run, longer), run)
    return np.stack([s.astype(np.int64) for s in slots(run)], 1).tolist() if words else []


def stripes(
    docs: DataFrame, length: int, least: int, bits=None, wide: np.ndarray | None = None, totals: bool = True
) -> DataFrame:
    """Merged stripes of all prefixes of ``length - 1`` words that may be frequent.

    ``lang``, ``prefix``, ``part`` (0, or of a wide prefix one of ``PARTS`` by the next word), ``total`` (of all
    entries) and ``next``: the entries of at least ``least``, ``word`` and ``n``. Without ``totals`` a stripe with no such
    entry is left out, and ``total`` is of those entries only: where a prefix goes on rarely nothing is passed on at all.
    Text of any length is taken in stretches; a task's stripes are merged by Spark's aggregation, which spills.
    """
    wide = np.zeros(0, dtype=np.uint64) if wide is None else wide
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def passed(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            for data in pieces(held.pop(lang)):
                out = stripes_of(lang, data, length, bits.value if bits else None, wide, buckets, totals)
                if out is not None:
                    yield out

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= CHUNK:
                    yield from passed(lang)
            if sum(sizes.values()) >= 2 * CHUNK:
                for lang in list(held):
                    yield from passed(lang)
        for lang in list(held):
            yield from passed(lang)

    # Dealt by bucket, stripes are merged where they are: a stripe, or a part of a wide one, has one bucket.
    # Packed as they are, they need more memory than their size in the shuffle tells, so tasks are not joined by it.
    dealt = docs.mapInArrow(count, STRIPES).repartition(parts, "bucket")
    key = ["lang", "bucket", "prefix", "part"]
    each = dealt.select("lang", "bucket", F.inline("stripes"))
    # No stripe is empty. "outer" keeps Spark from splitting the words once more to see that.
    entries = each.select(*key, "counts", F.posexplode_outer(F.split("words", " ")).alias("_i", "word"))
    entries = entries.groupBy(*key, "word").agg(F.sum(F.get("counts", F.col("_i"))).alias("n"))
    if not totals:
        entries = entries.where((F.col("n") >= least) & (F.col("word") != ""))
    kept = F.when((F.col("n") >= least) & (F.col("word") != ""), F.struct("word", "n"))
    return entries.groupBy(*key).agg(F.sum("n").alias("total"), F.collect_list(kept).alias("next")).drop("bucket")


def extensions(merged: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` and its count ``n``: the prefix of a stripe with each of its entries."""
    entry = merged.select("lang", "prefix", F.explode("next").alias("e"))
    phrase = F.when(F.col("prefix") == "", F.col("e.word")).otherwise(F.concat_ws(" ", "prefix", "e.word"))
    return entry.select("lang", phrase.alias("phrase"), F.col("e.n").alias("n"))


# In decimals: the product may pass 64 bits.
SCORE = "cast({a} as decimal(28,0)) * 2000000 div (cast({l} as decimal(28,0)) + {r})"
COVERED = "cast({longer} as decimal(28,0)) * 100 >= cast({a} as decimal(28,0)) * {covered}"


def _ranked(levels: list[DataFrame], words: DataFrame, longest: int, covered: int, top: int) -> DataFrame:
    """The ranked phrases from the merged stripes of all lengths, and the words of each language."""
    # A part of a frequent phrase is frequent itself, so its count is an entry of a shorter length.
    counts = reduce(DataFrame.unionByName, [extensions(m) for m in levels[:-1]]).withColumnRenamed("n", "f")
    found = reduce(DataFrame.unionByName, [extensions(m) for m in levels[1:]])
    word = F.split("phrase", " ")
    # Each way to cut a phrase asks for the counts of its two parts.
    ways = found.withColumn("word", word).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("word") - 1)))
    part = lambda first, n: F.array_join(F.slice("word", first, n), " ")
    asked = F.array(
        F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.size("word") - F.col("k")).alias("part")),
    )
    asked = ways.select("lang", "phrase", "k", F.explode(asked).alias("p")).select("lang", "phrase", "k", "p.*")
    answered = salted_join(
        asked, counts.withColumnRenamed("phrase", "part"), ["lang", "part"], ["phrase"], budget=Budget(rows=200_000)
    )
    fact = lambda rows, kind: rows.select("lang", "phrase", kind.alias("kind"), F.col("n").cast("bigint").alias("n"))
    # What a phrase is inside of: entries of its own stripe, and entries that end with it.
    inner = found.where(F.size(word) > 2)
    before = inner.withColumn("phrase", F.expr("substring(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)"))
    after = inner.withColumn("phrase", F.expr("substring(phrase, instr(phrase, ' ') + 1)"))
    facts = reduce(
        DataFrame.unionByName,
        [
            fact(found, F.lit("a")),
            fact(before, F.lit("longer")),
            fact(after, F.lit("longer")),
            fact(answered.withColumnRenamed("f", "n"), F.concat("side", F.col("k").cast("string"))),
        ],
    )
    kinds = ["a", "longer", *[f"{side}{k}" for side in "lr" for k in range(1, longest)]]
    known = facts.groupBy("lang", "phrase").agg(*[F.max(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in kinds])
    cuts = [
        F.when(
            F.col(f"l{k}").isNotNull(),
            F.struct(
                F.expr(SCORE.format(a="a", l=f"l{k}", r=f"r{k}")).alias("score"),
                F.lit(k).alias("k"),
                F.col(f"l{k}").alias("l"),
                F.col(f"r{k}").alias("r"),
            ),
        )
        for k in range(1, longest)
    ]
    inside = F.coalesce(F.expr(COVERED.format(longer="longer", a="a", covered=covered)), F.lit(False))
    free = known.where(F.col("a").isNotNull() & ~inside)
    free = free.select("lang", "phrase", "a", F.array_min(F.array(*cuts)).alias("cut")).select("lang", "phrase", "a", "cut.*")
    by = [F.desc("score"), F.desc("a"), "phrase"]
    # First the best of each of a few shares of a language, so that no task sees more than those.
    share = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("share")
    some = free.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*by)))
    some = some.where(F.col("rank") <= top).drop("rank", "share")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return best.join(words, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, covered: int = 80, top: int = 2_000) -> DataFrame:
    """The ``top`` phrases of each language by how much their parts keep together.

    Phrases have 2 to ``longest`` words of one piece of text and come up ``least`` times or more. Of the ways to cut a phrase in two, the one
    with the lowest ``score`` = floor(2000000 a / (l + r)) counts (ties: the shortest first part); ``a``, ``l``,
    ``r`` are the counts of phrase, first and second part, ``n`` of all words of the language. A phrase
    inside a longer one that comes up ``covered`` per cent as often goes. Ranked by score, then ``a``
    (both falling), then phrase in the order of its bytes.

    A NULL language is ``und``, a NULL or empty text has no words. Repeated rows count each time. Ids and other columns
    are not read. An empty table, or one without frequent phrases, gives no rows.
    """
    shipped(__name__)
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    )
    levels, bits, wide = [], None, None
    for length in range(1, longest + 1):
        merged = saved(stripes(rows, length, least, bits, wide, totals=length == 1), f"stripes{length}")
        levels.append(merged)
        if length == 1:
            words = merged.groupBy("lang").agg(F.sum("total").alias("n"))
            all_words = words.agg(F.sum("n")).first()[0] or 0
        if length < longest:
            found = extensions(merged)
            bits = _broadcast(spark, found)
            hot = found.where(F.col("n") * WIDE >= max(all_words, 1)).collect()
            wide = np.array([phrase_hash(r["lang"], r["phrase"]) for r in hot], dtype=np.uint64)
    return _ranked(levels, words, longest, covered, top)


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), runs AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 5)) AS k))
), f AS (
  SELECT lang, k, phrase, count(*) AS n FROM runs GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 30
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
    FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k))
  GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, j, x.n AS l, y.n AS r, CAST(2000000::HUGEINT * c.a // (x.n + y.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(w, 1, j), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(w, j + 1, c.k), ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest JOIN totals USING (lang) LEFT JOIN inside USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
WHERE rank <= 2000
"""
