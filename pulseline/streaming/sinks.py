"""Where streams end: topics, event tables, callbacks and reports.

Every writer takes a checkpoint folder, which holds read positions and state; a restarted query
goes on from there. Batches are written to folders of their own number, so that a batch that is
run again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pulseline.streaming import changelog
from pulseline.streaming.stepwise import remove


def event_table(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append events to one table, laid out by type and day so that rules read only their series."""
    return (
        stream.withColumn("event_date", F.to_date("ts"))
        .writeStream.format("parquet")
        .partitionBy("event_type", "event_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def topic_files(alerts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append alerts to one folder per topic."""
    return (
        alerts.writeStream.format("parquet")
        .partitionBy("topic")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def topics(alerts: DataFrame, servers: str, checkpoint: str) -> DataStreamWriter:
    """Publish alerts to the topics named in their ``topic`` column, as JSON."""
    body = F.to_json(F.struct(*[c for c in alerts.columns if c != "topic"]))
    return (
        alerts.select("topic", F.col("subject").alias("key"), body.alias("value"))
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
    )


def callback(
    stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> DataStreamWriter:
    """Hand each micro-batch to a function."""
    return stream.writeStream.outputMode(mode).foreachBatch(action).option("checkpointLocation", checkpoint)


def fan_out(
    stream: DataFrame, actions: list[Callable[[DataFrame, int], None]], checkpoint: str
) -> DataStreamWriter:
    """Several consumers of one stream, which is read only once."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for action in actions:
                action(batch, number)
        finally:
            batch.unpersist()

    return callback(stream, run, checkpoint)


def updates(state: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write every change of an aggregate's rows, in update mode: a history. ``kept_table`` keeps the newest only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return callback(state, write, checkpoint, mode="update")


def newest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current rows of an aggregate written by ``updates``."""
    changes = spark.read.parquet(path)
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*rest), "batch").alias("_newest")
    return changes.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def kept_table(state: DataFrame, path: str, checkpoint: str, keys: list[str], fanout: int = 8) -> DataStreamWriter:
    """Keep a table of an aggregate's current rows, in update mode: changes go to a log that is merged while it grows."""

    def write(batch: DataFrame, number: int) -> None:
        changelog.add(batch, path, number, keys, fanout)

    return callback(state, write, checkpoint, mode="update")


def report(
    stream: DataFrame,
    table: str,
    path: str,
    make: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    every: str = "1 second",
    keep: int | None = None,
) -> DataStreamWriter:
    """Store events and renew a report over the whole event table after each trigger.

    Of the reports the last ``keep`` stay, or all. For questions about devices, ``streaming.facts`` answers from
    state, without reading the table again.
    """

    def renew(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        spark = batch.sparkSession
        make(spark.read.parquet(table).drop("batch")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if keep and number >= keep:
            remove(spark, f"{path}/batch={number - keep}")

    return callback(stream, renew, checkpoint).trigger(processingTime=every)


def newest_report(spark: SparkSession, path: str) -> DataFrame:
    """The report of the latest trigger."""
    reports = spark.read.parquet(path)
    return reports.where(F.col("batch") == reports.select(F.max("batch")).scalar()).drop("batch")
