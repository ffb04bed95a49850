"""The registered queries of this folder, and the SQL that must give the same rows (if there is one)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseline.llm import (
    collocations,
    decontaminate,
    importance,
    jaccard,
    order_minhash,
    packing,
    quality,
    quality_rules,
    shards,
    suffixes,
    tokens,
    toxicity,
    warc,
)
from pulseline.llm.common import table
from pulseline.plans.registry import Query


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = jaccard.with_classes(table(spark, folder, "documents"), "cluster")
    return packing.packed(docs, cluster="cluster")


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.digests(shards.write_shards(table(spark, folder, "documents"), 40))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"), tokenizer_file())


def op4_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.edited_likeness(table(spark, folder, "documents"))


def op5_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digests(suffixes.deduplicated(table(spark, folder, "documents")))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_records(table(spark, folder, "pages"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.benchmark_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents")).drop("broken")


# Five bits at a time of the SHA-1, as letters.
OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
), bits AS (
  SELECT *, CAST(unhex(digest) AS BIT)::VARCHAR AS b, max(page_id) OVER (PARTITION BY digest) AS stored FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT)
    + CAST(substr(b, 5 * i + 5, 1) AS INT) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN stored <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN stored <> page_id THEN stored END AS refers_to
FROM bits
"""

QUERIES = {
    "op1_packing": Query(op1_packing),
    "op2_sharding": Query(op2_sharding),
    "op3_token_counts": Query(op3_token_counts),
    "op4_order_minhash": Query(op4_order_minhash),
    "op5_suffixes": Query(op5_suffixes),
    "op6_warc": Query(op6_warc, OP6_SQL),
    "op7_quality": Query(op7_quality),
    "op8_jaccard": Query(op8_jaccard),
    "op9_toxicity": Query(op9_toxicity),
    "op10_decontamination": Query(op10_decontamination),
    "op11_importance": Query(op11_importance, importance.SQL),
    "op12_collocations": Query(op12_collocations, collocations.SQL),
    "op13_quality_rules": Query(op13_quality_rules, quality_rules.sql()),
}
