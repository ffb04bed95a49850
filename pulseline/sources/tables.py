"""The event tables on Parquet, as batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseline.session import configure


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{table}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table with ``ts`` as a point in time (UTC).

    Stored times without a zone are read as points in time, not cast, so that conditions on them reach the files.
    """
    stored = load(spark, folder, "events").schema
    timed = [
        T.StructField(f.name, T.TimestampType(), f.nullable) if f.name == "ts" and isinstance(f.dataType, T.TimestampNTZType) else f
        for f in stored.fields
    ]
    df = spark.read.schema(T.StructType(timed)).parquet(f"{folder}/events.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def events_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The same table as an unbounded stream of files, whether it is one file or a folder of them.

    ``files_per_batch`` bounds what one micro-batch takes; without it each takes all there is.
    """
    path = f"{folder.rstrip('/')}/events.parquet"
    reader = spark.readStream.schema(load(spark, folder, "events").schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if _is_folder(spark, path):
        stream = reader.parquet(path)
    else:
        # A file stream watches a folder, so the file is named by a pattern, with nothing left open.
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def with_location(df: DataFrame) -> DataFrame:
    """Derive a position from each event: latitude from props.k, longitude from the row id."""
    k = F.get_json_object("props", "$.k").cast("int")
    return df.withColumns(
        {
            "lat": F.lit(39.0) + k * F.lit(0.03),
            "lon": F.lit(-107.0) + F.pmod(F.col("event_id") * 37, F.lit(170)) * F.lit(0.01),
        }
    )


def with_fix_text(df: DataFrame) -> DataFrame:
    """The same position as a text message, ``"<object> <lat> <lon>"``, under the key ``geo``."""
    k = F.get_json_object("props", "$.k").cast("int")
    # Hundredths of a degree in whole numbers give the same digits everywhere.
    lat = (F.lit(3900) + k * 3).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")
    lon = (F.lit(-10700) + F.pmod(F.col("event_id") * 37, F.lit(170))).cast("decimal(10,0)") / F.lit(
        100
    ).cast("decimal(3,0)")
    text = F.concat_ws(
        " ",
        F.col("user_id").cast("string"),
        lat.cast("decimal(10,2)").cast("string"),
        lon.cast("decimal(10,2)").cast("string"),
    )
    return df.withColumns({"key": F.lit("geo"), "value_text": text})
