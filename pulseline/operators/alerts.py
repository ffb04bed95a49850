"""One layout for the alerts of all rules, so that they can share topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_alert(
    df: DataFrame,
    topic: str,
    rule: str,
    subject: Column,
    valid_from: str,
    valid_to: str,
    measure: Column,
) -> DataFrame:
    return df.select(
        F.lit(topic).alias("topic"),
        F.lit(rule).alias("rule"),
        subject.cast("string").alias("subject"),
        F.col(valid_from).alias("valid_from"),
        F.col(valid_to).alias("valid_to"),
        measure.cast("double").alias("measure"),
    )


def all_alerts(*alerts: DataFrame) -> DataFrame:
    """Every alert of every rule; duplicates stay."""
    return reduce(DataFrame.unionByName, alerts)


def route_by_type(df: DataFrame, letter: Column) -> DataFrame:
    """Name the topic of each event after its type, as in ``type-A``."""
    return df.withColumn("topic", F.concat(F.lit("type-"), F.upper(letter)))
