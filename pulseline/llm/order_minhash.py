"""Order MinHash fingerprints: like MinHash, but sensitive to where things stand.

A text is a sequence of units: its words, and the characters of runs too long for a word. Its k-mers of
units get occurrence numbers, so that a repeated k-mer is several elements, and each element a
place on a ring of hash values. Each of ``SLOTS`` evenly spread marks on the ring stands for one
permutation (the ring turned to begin there): its minimal elements are the next two on the ring.
Put back into text order and hashed, they are one entry of the fingerprint. Two texts agree in an
entry if they share both elements *and* their order, so moving text about costs likeness too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import texts
from pulseline.llm.order import following

# Entries of a fingerprint (a power of two), and units in a k-mer.
SLOTS, K = 64, 2
# A longer run of characters, in a script without spaces say, is taken character by character.
LONGEST_WORD = 24
# An element is one whole number: 40 bits of hash, then 24 bits of place in the text (from 1 on). Of elements
# beyond the last place the order is not told; no text gets other elements for it.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1


def _packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(hashed, PLACE_BITS).bitwiseOR(F.least((place + F.lit(1)).cast("bigint"), F.lit(PLACE)))


def _hash_of(element: Column) -> Column:
    return F.shiftright(element, PLACE_BITS)


def _place_of(element: Column) -> Column:
    return element.bitwiseAND(F.lit(PLACE))


def _upto(n: Column) -> Column:
    """0 .. n-1; nothing for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: the fingerprint of the text column, as ``SLOTS`` small whole numbers.

    Each step is a column of its own, read more than once by the next, so nothing is computed twice
    inside a loop over units. An empty text has the fingerprint of no elements; so has a NULL.
    """
    kept = df.columns
    c = {x: f"_omh_{x}" for x in ("units", "kmers", "sorted", "starts", "ring", "marks", "elements")}
    col = {k: F.col(v) for k, v in c.items()}
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    df = df.withColumn(c["units"], words)
    cut = F.flatten(
        F.transform(col["units"], lambda w: F.when(F.length(w) > LONGEST_WORD, F.split(w, "")).otherwise(F.array(w)))
    )
    long_ones = F.exists(col["units"], lambda w: F.length(w) > LONGEST_WORD)
    df = df.withColumn(c["units"], F.when(long_ones, cut).otherwise(col["units"]))
    n = F.size(col["units"])
    kmer = lambda u, i: _packed(F.xxhash64(u, col["units"][i + 1]), i)
    df = df.withColumn(
        c["sorted"],
        F.sort_array(
            F.when(n >= K, F.transform(F.slice(col["units"], F.lit(1), F.greatest(n - 1, F.lit(0))), kmer)).otherwise(
                F.transform(col["units"], lambda u, i: _packed(F.xxhash64(u), i))
            )
        ),
    )
    s, n = col["sorted"], F.size(col["sorted"])
    key = lambda i: _hash_of(s[i])
    df = df.withColumn(
        c["starts"], F.filter(_upto(n), lambda i: (i == 0) | (key(i) != key(F.greatest(i - 1, F.lit(0)))))
    )
    starts = col["starts"]

    def numbered(start: Column, r: Column) -> Column:
        """The elements of one repeated k-mer: its hash with 0, 1, 2 .., each at its own place."""
        end = F.when(r + 1 < F.size(starts), starts[r + 1]).otherwise(n)
        return F.transform(
            F.sequence(start, end - 1),
            lambda i: _packed(F.xxhash64(key(start), i - start), _place_of(s[i]) - 1),
        )

    step = 1 << 64 - (SLOTS.bit_length() - 1)
    marks = F.array(*[F.lit((j - SLOTS // 2) * step).cast("bigint") for j in range(SLOTS)])
    df = df.withColumn(c["ring"], F.sort_array(F.concat(F.flatten(F.transform(starts, numbered)), marks)))
    ring = col["ring"]
    df = df.withColumns(
        {
            c["elements"]: F.filter(ring, lambda x: _place_of(x) != 0),
            c["marks"]: F.filter(_upto(F.size(ring)), lambda i: _place_of(ring[i]) == 0),
        }
    )
    e = col["elements"]
    size = F.size(e)

    def entry(at: Column, mark: Column) -> Column:
        first, second = e[F.pmod(at - mark, size)], e[F.pmod(at - mark + 1, size)]
        swap = _place_of(first) > _place_of(second)
        a, b = _hash_of(first), _hash_of(second)
        both = F.when(swap, F.xxhash64(b, a)).otherwise(F.xxhash64(a, b))
        return both.bitwiseAND(F.lit(0x7FFF)).cast("smallint")

    none = F.array_repeat(F.lit(-1).cast("smallint"), SLOTS)
    print_ = F.when(size > 0, F.transform(col["marks"], entry)).otherwise(none)
    return df.select(*kept, print_.alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two fingerprints, from 0 to 1."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.lit(float(SLOTS))


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("int").bitwiseAND(F.lit(0xFFFF))), 4, "0")), ""))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of an edited form of it, and how alike they are.

    In the edited text the last half of the characters is replaced by as many first characters of
    the next document in the order of ``doc_id`` (or all it has; the last document takes the first).
    One row per row of ``docs``. Rows with the same id and text are one document in that order and
    get the same result; equal ids with other texts follow each other by a hash of the text; NULL
    ids come first. A NULL text is empty. A lone document is its own next one.
    """
    rows = texts(docs).withColumn("hash", F.xxhash64("text"))
    keys = rows.select("doc_id", "hash", F.length("text").cast("bigint").alias("n_chars"))
    # NULL ids would not join; two plain columns stand for the id.
    key = lambda p="": [F.col(f"{p}id"), F.col(f"{p}no_id"), F.col(f"{p}hash")]
    plain = {"id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()}
    keys = keys.withColumns(plain).groupBy("id", "no_id", "hash").agg(
        F.max("n_chars").alias("n_chars"), F.count("*").alias("copies")
    )
    order = following(
        keys.withColumn("has_id", ~F.col("no_id")), ["has_id", "id", "hash"]
    ).drop("has_id")
    repeated = order.where("copies > 1").limit(1).count() > 0

    # For each document the one before it, and how much of its own text goes there.
    before = order.select(
        F.col("next_seq").alias("seq"),
        *[x.alias(f"to_{x_name}") for x, x_name in zip(key(), ("id", "no_id", "hash"))],
        F.expr("n_chars div 2").alias("wanted"),
    )
    links = order.select("id", "no_id", "hash", "seq").join(before, "seq").drop("seq")

    own = rows.withColumns(plain).select("id", "no_id", "hash", "text")
    if repeated:
        own = own.dropDuplicates(["id", "no_id", "hash"])
    # The fingerprint is made before the shuffle that both sides below share.
    own = with_fingerprint(own, "text", "print")
    given = own.join(links, ["id", "no_id", "hash"]).select(
        F.col("to_id").alias("id"),
        F.col("to_no_id").alias("no_id"),
        F.col("to_hash").alias("hash"),
        F.expr("substring(text, 1, cast(wanted as int))").alias("added"),
        F.col("print").alias("next_print"),
    )
    both = own.join(given, ["id", "no_id", "hash"]).withColumn("n_chars", F.length("text").cast("bigint"))
    left = F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))")
    edited = both.withColumn("edited", F.concat(left, F.col("added"))).drop("text", "added")
    out = with_fingerprint(edited, "edited", "edited_print")
    if repeated:
        copies = order.where("copies > 1").select("id", "no_id", "hash", "copies")
        out = out.join(copies, ["id", "no_id", "hash"], "left")
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
    return out.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
