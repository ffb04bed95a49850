"""Best-fit packing of documents into sequences of bounded length, under conflicts.

No two documents of a bin may share a source, be copies of each other or share a given cluster. Bins are kept in the order
of the room they have left, each with a bitmap of the sources and of the duplicate clusters in it.
A piece looks for the first bin with room enough, and from there along the successors for the first
that has none of its bits: the tightest bin that it is compatible with. If there is none, it opens one.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import shipped

PLACED = (
    "doc_id bigint, hash bigint, copy bigint, source string, piece bigint, start bigint, length bigint, "
    "bin_id bigint, position int, offset bigint, room_left bigint"
)


def best_fit(sizes: list[int], bits: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each piece, in the order given, and the room that is left in each bin."""
    order: list[tuple[int, int]] = []  # (room left, bin), ascending
    room, held, chosen = [], [], []
    for size, bit in zip(sizes, bits):
        at = bisect_left(order, (size, -1))
        while at < len(order) and held[order[at][1]] & bit:
            at += 1
        if at < len(order):
            left, b = order.pop(at)
            held[b] |= bit
        else:
            left, b = capacity, len(room)
            room.append(0)
            held.append(bit)
        room[b] = left - size
        if room[b]:
            insort(order, (room[b], b))
        chosen.append(b)
    return chosen, room


def bitmaps(sources: list, *clusterings: list) -> list[int]:
    """A bit for each source of the group, and one for each cluster with several pieces there."""
    numbers: dict = {}
    out = [0 if s is None else 1 << numbers.setdefault(("source", s), len(numbers)) for s in sources]
    for k, clusters in enumerate(clusterings):
        several = pd.Series(clusters).duplicated(keep=False).tolist()
        for i, (cluster, repeated) in enumerate(zip(clusters, several)):
            if repeated and cluster is not None:
                out[i] |= 1 << numbers.setdefault((k, cluster), len(numbers))
    return out


def pieces(docs: DataFrame, capacity: int, cluster: str | None = None) -> DataFrame:
    """What is packed: whole texts, and texts longer than a bin in pieces that fill one each, and a rest.

    Repeated rows are counted first and then numbered, so that copies of one row spread like others.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.col("source").cast("string").alias("source"),
        (F.col(cluster) if cluster else F.lit(None)).cast("string").alias("cluster"),
    )
    most = capacity - 1  # one character stays for the separator
    counted = rows.groupBy("doc_id", "source", F.xxhash64("text").alias("hash"), F.length("text").cast("bigint").alias("n")).agg(
        F.count("*").alias("copies"), F.min("cluster").alias("cluster")
    )
    last = F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0)).cast("bigint")
    return (
        counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("start", F.col("piece") * most)
        .withColumn("length", F.least(F.col("n") - F.col("start"), F.lit(most)))
        .drop("copies", "n")
    )


def assigned(
    docs: DataFrame, capacity: int = 16_384, group: int = 4_096, seed: int = 23, cluster: str | None = None
) -> DataFrame:
    """The bin and place of each piece of each document; the columns are those of ``PLACED``.

    Pieces are dealt by hash into groups of about ``group``, each packed on its own, longest first;
    so every task packs a bounded number of pieces, whatever their sources are. An empty text needs
    no room: its bin is NULL.
    """
    if capacity < 2 or group < 1:
        raise ValueError("a bin needs room for a character and a separator, a group for a piece")
    shipped(__name__)
    all_pieces = pieces(docs, capacity, cluster)
    full = F.col("length") > 0
    n = all_pieces.where(full).count()
    groups = max(1, -(-n // group))
    dealt = all_pieces.where(full).withColumn(
        "grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "hash", "source", "copy", "piece"), F.lit(groups))
    )

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(
            ["length", "doc_id", "hash", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable"
        )
        sizes = (frame["length"] + 1).to_numpy()
        source, own = ([s if isinstance(s, str) else None for s in frame[c]] for c in ("source", "cluster"))
        bits = bitmaps(source, frame["hash"].tolist(), own)
        chosen, room = best_fit(sizes.tolist(), bits, capacity)
        bins = np.array(chosen, dtype=np.int64)
        by_bin = pd.Series(bins, index=frame.index)
        frame = frame.assign(
            bin_id=(int(key[0]) << 32) + by_bin,
            position=by_bin.groupby(by_bin).cumcount().astype("int32"),
            offset=pd.Series(sizes, index=frame.index).groupby(by_bin).cumsum() - sizes,
            room_left=np.array(room, dtype=np.int64)[bins],
            doc_id=frame["doc_id"].astype("Int64"),
        )
        return frame[[c.split()[0] for c in PLACED.split(", ")]]

    placed = dealt.groupBy("grp").applyInPandas(pack, PLACED)
    empty = all_pieces.where(~full)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in PLACED.split(", ")[7:])]
    return placed.unionByName(empty.select(*[c.split()[0] for c in PLACED.split(", ")[:7]], *nothing))


def packed(docs: DataFrame, capacity: int = 16_384, group: int = 4_096, cluster: str | None = None) -> DataFrame:
    """Where each piece of each text goes, without the texts.

    Rows: ``doc_id``, ``copy`` (of repeated rows, from 1), ``source``, ``piece``, ``start`` and ``length`` in
    characters, ``bin_id``, ``position`` and ``offset`` in the bin, ``room_left`` in the bin. A NULL text
    is empty. A NULL source conflicts with nothing. Texts are copies if they are equal (by hash).
    ``cluster`` may name a column with the cluster of each text, such as its group of near copies: pieces of
    one cluster share no bin (NULL is none; repeated rows are of the first of theirs).
    """
    return assigned(docs, capacity, group, cluster=cluster).drop("hash")


def packed_texts(docs: DataFrame, capacity: int = 16_384, group: int = 4_096) -> DataFrame:
    """The same with the text of each piece, ready to be written bin by bin."""
    places = assigned(docs, capacity, group)
    plain = {
        "_id": F.coalesce("doc_id", F.lit(0)),
        "_no_id": F.col("doc_id").isNull(),
        "_source": F.coalesce("source", F.lit("")),
        "_no_source": F.col("source").isNull(),
    }
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("text"), F.lit("")).alias("whole"),
    ).withColumn("hash", F.xxhash64("whole"))
    own = own.withColumns(plain).drop("doc_id", "source")
    keys = [*plain, "hash"]
    if places.where("copy > 1").limit(1).count():
        own = own.dropDuplicates(keys)
    part = F.expr("substring(whole, cast(start + 1 as int), cast(length as int))")
    return places.withColumns(plain).join(own, keys).withColumn("text", part).drop("whole", *keys)
