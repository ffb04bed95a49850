"""What the operators of this folder share."""

from __future__ import annotations

import sys
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.session import work_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables; any path Spark can read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shipped(module: str) -> ModuleType:
    """Send the functions of a module to executors by value: they need no copy of this library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
    return sys.modules[module]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Later steps start from the written table, so a lost executor costs only their own tasks.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a NULL text as the empty one; other columns cannot clash."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def n_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often and deep ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
