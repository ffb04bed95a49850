"""A corpus from raw documents to packed sequences, as stages that each read what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.llm import decontaminate, jaccard, packing, quality, suffixes
from pulseline.llm.common import saved, table


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    return jaccard.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier ones have; a document with nothing left goes.

    ``n_chars`` follows the text. Characters that a passage covers in part stay.
    """
    done = suffixes.deduplicated(docs, carry=docs.columns)
    rest = lambda c: F.col("rest").getField(c)
    kept = done.where((F.col("kept_text") != "") | (F.col("n_bytes") == 0))
    own = {
        "text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(rest("text")),
        "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(
            rest("n_chars")
        ),
    }
    return kept.select(*[own.get(c, rest(c)).alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of each piece of text, with the piece."""
    return packing.packed_texts(docs)


STAGES = [
    ("quality", good_texts),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("packing", sequences),
]

# Model training and randomised joins cannot be said in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
