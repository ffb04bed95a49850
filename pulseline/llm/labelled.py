"""Labels, folds and bounded samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row belongs to the fold that is never learned from (a NULL id does not)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """``doc_id``, ``label`` (0 or 1) outside the held-out fold; the larger one where a document has several."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(name).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def sampled(rows: DataFrame, n: int, seed: int = 11) -> DataFrame:
    """At most ``n`` rows, the ones with the smallest hash of their id: the same ones in every run.

    Rows are counted first; only somewhat more than ``n`` of them pass the hash and are sorted.
    """
    total = rows.count()
    place = F.xxhash64(F.lit(seed), "doc_id")
    if total > 2 * n:
        share = (n + 6 * n**0.5 + 50) / total
        rows = rows.where(place < F.lit(int(min(share, 1) * 2**64 - 2**63)))
    return rows.orderBy(place).limit(n)
