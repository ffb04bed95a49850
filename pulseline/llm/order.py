"""The order of documents, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseline.llm.common import saved


def following(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows in the order ``by``, each with ``seq`` and the ``next_seq`` of the row after it.

    The last row is followed by the first. Rows are dealt by range and numbered inside their
    partition, so no task sees more than its range; only one row per partition meets the others.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # Written, as the ranges come from a sample and must not be drawn anew.
    ordered = saved(ordered.withColumn("seq", F.monotonically_increasing_id()), "order")
    part = F.shiftrightunsigned("seq", 33)
    ends = ordered.groupBy(part.alias("part")).agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    along = Window.orderBy("part")
    start = F.min("first").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seams = ends.select(F.col("last").alias("seq"), F.coalesce(F.lead("first").over(along), start).alias("after"))
    return ordered.join(seams, "seq", "left").select(
        *keys.columns, "seq", F.coalesce("after", F.col("seq") + 1).alias("next_seq")
    )


def distinct(docs: DataFrame, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``uid``, ``text`` and ``rest`` (the columns in ``carry``) of distinct documents, in the order of ``uid``.

    Mostly ids are distinct and ``uid`` is the id; the second result is None then. Where ids repeat or are
    NULL, rows with the same id and text become one, numbered in the order of the id (NULL
    first) and a hash of the text; the second result has ``has_id``, ``id``, ``hash``, ``copies`` and ``uid``.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        # A row must have a field; the columns carried bring their own names.
        (F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))).alias("rest"),
    )
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.where((F.col("n") > 1) | F.col("doc_id").isNull()).limit(1).count():
        return rows.select(F.col("doc_id").alias("uid"), "text", "rest"), None
    plain = [
        F.col("doc_id").isNotNull().alias("has_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64("text").alias("hash"),
    ]
    by = ["has_id", "id", "hash"]
    keys = rows.select(*plain).groupBy(*by).agg(F.count("*").alias("copies"))
    order = saved(following(keys, by).select(*by, "copies", F.col("seq").alias("uid")), "uids")
    own = rows.select(*plain, "text", "rest").dropDuplicates(by)
    return saved(own.join(order, by).select("uid", "text", "rest"), "distinct"), order
