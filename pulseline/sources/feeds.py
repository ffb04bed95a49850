"""Message feeds: text and Avro topics, and JSON lines.

The topic readers need Spark's Kafka module on the class path. Each decoder is a
separate function over a DataFrame, so it can be used on any source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.functions import avro
from pulseline.functions.text import parse_location
from pulseline.schemas import JSON_EVENT

AVRO_EVENT_SCHEMA = """
{"type": "record", "name": "EventRecord", "fields": [
  {"name": "DeviceID", "type": "int"},
  {"name": "Timestamp", "type": "long"},
  {"name": "EventID", "type": "int"},
  {"name": "EventData", "type": {"type": "record", "name": "EventDataRecord", "fields": [
    {"name": "Latitude", "type": "float"},
    {"name": "Longitude", "type": "float"},
    {"name": "Accuracy", "type": "int"}]}}]}
"""


def topic_stream(
    spark: SparkSession, servers: str, topic: str = "all-event-data", start: str = "earliest"
) -> DataFrame:
    """Raw records of a topic. Read positions live in the checkpoint of the query."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
        .load()
    )


def decode_text(records: DataFrame) -> DataFrame:
    """Binary key and value to the plain event layout; the record time is the event time."""
    return records.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("timestamp").alias("ts"),
    )


def decode_avro(records: DataFrame, schema: str = AVRO_EVENT_SCHEMA) -> DataFrame:
    """Registry-framed Avro values to typed events; a malformed value becomes an event of NULLs.

    The bytes are read in column expressions (``functions.avro``), so Spark's Avro module is not needed.
    """
    parts = records.select(avro.cut(F.col("value"), schema).alias("parts"))
    return typed_avro(parts.select(avro.record(F.col("parts"), schema).alias("e")).select("e.*"))


def typed_avro(decoded: DataFrame) -> DataFrame:
    """Decoded Avro events with a real time column and flat coordinates."""
    return decoded.select(
        F.col("DeviceID").alias("device_id"),
        F.timestamp_seconds("Timestamp").alias("ts"),
        F.col("EventID").alias("event_type"),
        F.col("EventData.Latitude").alias("latitude"),
        F.col("EventData.Longitude").alias("longitude"),
        F.col("EventData.Accuracy").alias("accuracy"),
        F.lit(True).alias("is_temporal"),
    )


def json_files(spark: SparkSession, folder: str, streaming: bool = True) -> DataFrame:
    """JSON-lines files of events, read as a stream or in one go."""
    reader = spark.readStream if streaming else spark.read
    return typed_json(reader.schema(JSON_EVENT).json(folder))


def decode_json(messages: DataFrame, column: str = "value") -> DataFrame:
    """JSON text in a column to typed events."""
    return typed_json(
        messages.select(F.from_json(column, JSON_EVENT).alias("e")).select("e.*")
    )


def typed_json(parsed: DataFrame) -> DataFrame:
    """Absent numbers and flags take their type's zero; a malformed location stays NULL."""
    return parsed.select(
        F.coalesce("DeviceID", F.lit(0)).alias("device_id"),
        F.col("Timestamp").alias("ts"),
        F.coalesce(F.col("EventID").cast("int"), F.lit(0)).alias("event_type"),
        F.col("EventData").alias("event_data"),
        parse_location(F.col("EventData")).alias("location"),
        F.coalesce("IsTemporal", F.lit(False)).alias("is_temporal"),
    )


def publish_text(df: DataFrame, servers: str, topic: str) -> None:
    """Backfill a topic from a batch DataFrame with ``key`` and ``value`` text."""
    (
        df.select(F.col("key").cast("string"), F.col("value").cast("string"))
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def publish_avro(df: DataFrame, servers: str, topic: str, schema: str = AVRO_EVENT_SCHEMA) -> None:
    """Backfill a topic with Avro records (without registry framing)."""
    from pyspark.sql.avro.functions import to_avro

    body = F.struct("DeviceID", "Timestamp", "EventID", "EventData")
    (
        df.select(to_avro(body, schema).alias("value"))
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
