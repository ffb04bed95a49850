"""Target-distribution importance resampling: documents drawn by how much their words look like a target's.

Features of a text are its runs of 1 to ``longest`` words, hashed by CRC-32 into buckets. The vocabulary is
cut in two. The head is broadcast: the CRC states of the most frequent words of the corpus, counted over
all of it, and the buckets of its most frequent pairs. What is not in the head, the tail, takes its CRC
from its bytes; a longer run goes on from the state of the run before it. The head saves work and changes
no result, so both feed the same exact bucket totals, whatever the head's size.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.llm.common import saved, shipped, texts

# Bounds of the head, which is broadcast: words, bytes of a word in it, pairs.
HEAD_WORDS, HEAD_WORD_BYTES, HEAD_PAIRS = 32_768, 48, 65_536
# Bytes of text taken at once, and entries of a counter before a task passes it on.
CHUNK, COUNTED = 4 << 20, 1 << 19
LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
# A-Z to a-z, everything else below 128 that is no part of a word to a space.
PLAIN = bytes(c if c >= 128 or c in LETTERS else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
TWO_32 = 4294967296.0


@dataclass(frozen=True)
class Head:
    states: dict[bytes, int] = field(default_factory=dict)
    pairs: dict[tuple[bytes, bytes], int] = field(default_factory=dict)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """The texts of a partition, as many at a time as ``CHUNK`` allows; a longer one alone."""
    for batch in batches:
        texts_ = batch["text"]
        part = (texts_.str.len().cumsum() // CHUNK).to_numpy()
        for _, own in texts_.groupby(part, sort=False):
            yield own


def features(words: list[list[bytes]], head: Head, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each feature of some texts, and the place of its text among them."""
    flat = [w for own in words for w in own]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    text = np.repeat(np.arange(len(words)), sizes)
    states = [zlib.crc32(w) if s is None else s for s, w in zip(map(head.states.get, flat), flat)]
    out, place = [np.array(states, dtype=np.int64) % buckets], [text]
    for n in range(2, longest + 1):
        starts = np.flatnonzero(text[: 1 - n] == text[n - 1 :]) if len(flat) >= n else np.zeros(0, dtype=np.int64)
        own, longer = np.zeros(len(starts), dtype=np.int64), {}
        for k, i in enumerate(starts.tolist()):
            known = head.pairs.get((flat[i], flat[i + 1])) if n == 2 else None
            if known is None or n < longest:
                longer[i] = zlib.crc32(b" " + flat[i + n - 1], states[i])
            own[k] = longer[i] % buckets if known is None else known
        states = longer
        out.append(own)
        place.append(text[starts])
    return np.concatenate(out), np.concatenate(place)


def _counted(docs: DataFrame, keys_of, name: str, most: int) -> list:
    """The keys of all texts that come up most often, at most ``most``.

    Keys are taken class by class of their counts, so far as whole classes fit: the driver sees one number per class
    and no more than ``most`` keys.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def passed() -> pd.DataFrame:
            return pd.DataFrame({"key": list(held), "n": list(held.values())})

        for own in chunks(batches):
            held.update(keys_of(own))
            if len(held) > COUNTED:
                yield passed()
                held.clear()
        yield passed()

    partial = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInPandas(count, "key binary, n bigint")
    total = partial.groupBy("key").agg(F.sum("n").alias("n"))
    total = saved(total.withColumn("class", F.floor(8 * F.log2("n")).cast("int")), name)
    least, held = None, 0
    for row in total.groupBy("class").count().orderBy(F.desc("class")).collect():
        held += row["count"]
        if held > most:
            break
        least = row["class"]
    if least is None:
        return []
    return [bytes(r["key"]) for r in total.where(F.col("class") >= least).select("key").collect()]


def head_of(docs: DataFrame, longest: int, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS, buckets: int = 10_000) -> Head:
    """The head of the vocabulary, of at most so many words and pairs: counted over whole texts of all rows."""
    shipped(__name__)
    spark = docs.sparkSession

    def short_words(own: pd.Series) -> Iterator[bytes]:
        return (w for t in own for w in words_of(t) if len(w) <= HEAD_WORD_BYTES)

    states = {w: zlib.crc32(w) for w in _counted(docs, short_words, "words", words)} if words else {}
    if longest < 2 or not pairs:
        return Head(states)
    # Both words of a frequent pair are frequent.
    given = spark.sparkContext.broadcast(states)

    def known_pairs(own: pd.Series) -> Iterator[bytes]:
        for t in own:
            w = words_of(t)
            yield from (a + b" " + b for a, b in zip(w, w[1:]) if a in given.value and b in given.value)

    found = [k.split(b" ") for k in _counted(docs, known_pairs, "pairs", pairs)]
    return Head(states, {(a, b): zlib.crc32(b" " + b, states[a]) % buckets for a, b in found})


def bucket_totals(docs: DataFrame, head: Head, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task passes on its own totals."""
    shipped(__name__)
    given = docs.sparkSession.sparkContext.broadcast(head)

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(buckets, dtype=np.int64)
        for own in chunks(batches):
            found, _ = features([words_of(t) for t in own], given.value, buckets, longest)
            held += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": at, "n": held[at]})

    partial = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInPandas(total, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier a bucket is in the target, one added to each count."""
    buckets = len(source)
    s_all, t_all = float(source.sum() + buckets), float(target.sum() + buckets)
    ratios = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def weights(docs: DataFrame, head: Head, gain: np.ndarray, longest: int) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight``, the sum of its features' gains, of every row."""
    shipped(__name__)
    given = docs.sparkSession.sparkContext.broadcast((head, gain))

    def weigh(own: pd.Series) -> pd.DataFrame:
        head, gain = given.value
        words = [words_of(t) for t in own]
        found, place = features(words, head, len(gain), longest)
        weight = np.zeros(len(words), dtype=np.int64)
        np.add.at(weight, place, gain[found])
        return pd.DataFrame(
            {"n_words": [len(w) for w in words], "n_features": np.bincount(place, minlength=len(words)), "weight": weight}
        )

    @F.pandas_udf("n_words bigint, n_features bigint, weight bigint")
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [weigh(own) for own in chunks(iter([batch.to_frame("text")]))]
            yield pd.concat(parts) if parts else weigh(batch)

    return texts(docs).select("doc_id", weighed(F.col("text").cast("binary")).alias("w")).select("doc_id", "w.*")


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel number, times 1000 and rounded down, that ``seed`` and id fix."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(TWO_32)))).cast("bigint")


def ranked(rows: DataFrame, fit: Column, percent: int) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 .. by score for the first ``percent`` of those that are ``fit``, else NULL.

    Dealt by range and numbered inside each partition; a row's place in the input splits equal rows,
    so they need not share a task.
    """
    spark = rows.sparkSession
    n = rows.where(fit).count() * percent // 100
    by = [F.desc("fit"), F.desc("score"), F.asc_nulls_first("doc_id")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumns({"fit": fit, "tie": F.monotonically_increasing_id()})
    ordered = tied.repartitionByRange(parts, *by, "tie").sortWithinPartitions(*by, "tie").drop("tie")
    # Written, as the ranges come from a sample and must not be drawn anew.
    ordered = saved(ordered.withColumn("seq", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("seq", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    offsets = sizes.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("offset"))
    place = ordered.withColumn("part", part).join(offsets, "part").withColumn("place", F.col("seq") + F.col("offset"))
    drawn = F.when(F.col("fit") & (F.col("place") <= n), F.col("place"))
    return place.withColumn("rank", drawn.cast("bigint")).select(*rows.columns, "rank")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = 10_000,
    longest: int = 1,
    least_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
    head: Head | None = None,
) -> DataFrame:
    """Draw ``percent`` of the documents of ``least_words`` words or more, without replacement, by importance.

    A row per row of ``docs``: ``doc_id``, ``n_features``, ``weight``, ``score`` (the weight plus Gumbel
    noise, so the highest scores are a draw), ``rank`` (NULL if not drawn). Words are runs of a-z (A-Z in lower case), 0-9 and all that is not
    ASCII. A NULL or empty text has no features and weight 0. A NULL id is the smallest one, its noise that
    of an empty id. Repeated rows count each time and have ranks of their own. An empty target has no features;
    an empty table gives no rows. Other columns of either table are not read.
    """
    docs, target = texts(docs), texts_only(target)
    if head is None:
        head = head_of(docs, longest, buckets=buckets)
    source = bucket_totals(docs, head, buckets, longest)
    gain = gains(source, bucket_totals(target, head, buckets, longest))
    weighed = weights(docs, head, gain, longest)
    scored = saved(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    out = ranked(scored, F.col("n_words") >= least_words, percent)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def texts_only(target: DataFrame) -> DataFrame:
    return target.select(F.col("text"))


# CRC-32 by its table of 256 entries, of distinct words only.
SQL = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1
      THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), w AS (
  SELECT false AS wanted, r, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
  UNION ALL
  SELECT true, NULL, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
  FROM benchmark
), v AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(word)),
      lambda i: CAST('0x' || substr(hex(word), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM w), crc
), f AS (
  SELECT w.wanted, w.r, v.bucket FROM w JOIN v USING (word)
), totals AS (
  SELECT b.bucket, count(f.bucket) FILTER (WHERE NOT wanted) AS s, count(f.bucket) FILTER (WHERE wanted) AS t
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN f ON f.bucket = b.bucket GROUP BY b.bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM totals) + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM totals) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM totals
), d AS (
  SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN gains USING (bucket) WHERE NOT wanted GROUP BY r
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN d USING (r)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""
