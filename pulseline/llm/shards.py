"""Shuffling a corpus into shards on disk, in two passes.

Pass one scatters rows over memory-sized buckets by a seeded hash. Pass two shuffles each bucket in
memory (Spark's ``shuffle`` is a Fisher-Yates shuffle) and writes it. One bucket after the other is
a random order of all rows; cut into equal stretches it gives the shards, so a bucket feeds one or
two of them, and few files are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseline.llm.common import saved
from pulseline.session import work_dir

# Bytes that a row counts besides its text.
ROW_BYTES = 16


def write_shards(
    docs: DataFrame,
    n_shards: int = 40,
    seed: int = 7,
    bucket_bytes: int = 24 << 20,
    max_tasks: int = 20_000,
    path: str | None = None,
) -> DataFrame:
    """Write all rows of ``docs`` in random order as ``n_shards`` shards; returns what was written.

    Result: ``record`` (the row as it came, whatever its columns are called), ``shard`` and ``slot``,
    the place in the shard, gapless from 0. Shard sizes differ by one row at most. NULL texts and
    ids are rows like others; equal texts need not meet in a shard. An empty table gives empty shards.

    The seed, the rows and ``bucket_bytes`` fix the order: buckets are sorted by id and text before
    they are shuffled. If a bucket gets over four times its size, as many rows have the same id and
    text, a row's place in the input joins its hash.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    rows = docs.select(F.struct(*docs.columns).alias("record"))
    text, doc_id = F.col("record.text"), F.col("record.doc_id")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    n_buckets = max(1, -(-total["bytes"] // bucket_bytes))

    def scattered(*by) -> DataFrame:
        bucket = F.pmod(F.xxhash64(F.lit(seed), doc_id, *by), F.lit(n_buckets)).cast("bigint")
        return rows.withColumn("bucket", bucket)

    def sizes_of(placed: DataFrame) -> DataFrame:
        return placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))

    placed = scattered(F.crc32(text))
    sizes = sizes_of(placed)
    if n_buckets > 1 and sizes.where(F.col("bytes") > 4 * bucket_bytes).limit(1).count():
        # Places may come out otherwise when they are asked for again, so these buckets are written.
        placed = saved(scattered(F.monotonically_increasing_id()), "scattered")
        sizes = sizes_of(placed)

    # One short row per bucket.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    shuffled = (
        placed.repartition(min(n_buckets, max_tasks), "bucket")
        .sortWithinPartitions("bucket", "record.doc_id", "record.text")
        .groupBy("bucket")
        .agg(F.collect_list("record").alias("records"))
        .select("bucket", F.posexplode(F.shuffle("records", seed)).alias("at", "record"))
    )
    n = total["n"]
    place = F.col("start") + F.col("at")
    shard = F.expr(f"((start + at + 1) * {n_shards} - 1) div {max(n, 1)}")
    first = F.expr(f"(shard * {n}) div {n_shards}")
    out = (
        shuffled.join(starts, "bucket")
        .withColumn("shard", shard)
        .select("record", F.col("shard").cast("int").alias("shard"), (place - first).cast("bigint").alias("slot"))
    )
    path = path or work_dir(spark, "shards")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    schema = T.StructType([*[f for f in out.schema if f.name != "shard"], T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def digests(written: DataFrame, n_shards_law: str = "rows") -> DataFrame:
    """Short columns of what ``write_shards`` wrote; a NULL text counts as no bytes, with CRC 0."""
    text = F.col("record.text")
    return written.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit(n_shards_law).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
