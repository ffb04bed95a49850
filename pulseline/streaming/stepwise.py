"""Operators on a stream that comes in slices of time.

Each micro-batch is a piece of the stream: all events of a slice, and none of a later one before it (see
``sources.slices``). A step is an ordinary batch computation over the slice and a small table that the slice
before has carried over. It gives rows, the table for the next slice, and what it has persisted to make them. Both are written under the number
of the micro-batch, so a batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pulseline.functions.temporal import micros
from pulseline.streaming.changelog import names

# (slice, carried) -> (rows, carry, *persisted)
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, ...]]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stepwise(stream: DataFrame, step: Step, carry: str, path: str, checkpoint: str) -> DataStreamWriter:
    """Run ``step`` on each slice; its rows go below ``path``. ``carry`` is the layout of what is carried, as DDL.

    Only the carried tables of the last two slices are kept: the newest, and the one from which it would be made again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.createDataFrame([], carry)
        if number:
            before = spark.read.schema(carry).parquet(f"{path}/carry/{number - 1}")
        held = [batch.persist()]
        try:
            rows, after, *more = step(batch, before)
            held += more
            rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            after.select(*before.columns).write.mode("overwrite").parquet(f"{path}/carry/{number}")
        finally:
            for table in held:
                table.unpersist()
        if number > 1:
            remove(spark, f"{path}/carry/{number - 2}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def pair_step(pairs: Callable[[DataFrame, int], DataFrame], apart: int) -> Step:
    """Pairs of events at most ``apart`` microseconds from each other, as a step.

    The stream brings only what is joined and carried (with its ``ts``), as a slice is held while it is joined; ``pairs`` gives the pairs of a table that have
    an event of a time (in microseconds) or later. A slice is joined with itself and with what the slices
    before can still reach it with, as a batch: each event is read once more at most, and none waits in a state store.
    """

    def step(batch: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = batch.select(*before.columns).where(F.col("ts").isNotNull())
        since, newest = new.agg(F.min(micros(F.col("ts"))), F.max(micros(F.col("ts")))).first()
        if since is None:  # nothing new: what was carried still waits
            return pairs(before.limit(0), 0), before
        known = before.unionByName(new)
        return pairs(known, since), known.where(micros(F.col("ts")) >= newest - apart)

    return step


def window_step(
    slim: Callable[[DataFrame], DataFrame], windows: Callable[[DataFrame], DataFrame], size: int
) -> tuple[Step, Callable[[DataFrame], DataFrame]]:
    """Windows of ``size`` microseconds over what ``slim`` makes of a slice, as a step; and what gives those still open at the end.

    ``windows`` computes them from a table, as a batch, with their ``window_end``. A window's row comes with the slice that
    brings an event at its end or later. Events are carried as long as an open window may hold them.
    """

    def step(batch: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = slim(batch).select(*before.columns).where(F.col("ts").isNotNull())
        newest = new.agg(F.max(micros(F.col("ts")))).first()[0]
        if newest is None:  # nothing new: what was carried still waits
            return windows(before.limit(0)), before
        since = before.agg(F.max(micros(F.col("ts")))).first()[0]
        known, end = before.unionByName(new), micros(F.col("window_end"))
        over = end <= newest if since is None else (end <= newest) & (end > since)
        return windows(known).where(over), known.where(micros(F.col("ts")) > newest - size)

    def still_open(carry: DataFrame) -> DataFrame:
        newest = carry.agg(F.max(micros(F.col("ts")))).first()[0]
        return windows(carry).where(micros(F.col("window_end")) > (newest or 0))

    return step, still_open


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``stepwise`` has written."""
    return spark.read.parquet(f"{path}/rows").drop("batch")


def carried(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """What slice ``number`` has carried over, by default the last one."""
    if number is None:
        number = max(int(n) for n in names(spark, f"{path}/carry") if n.isdigit())
    return spark.read.parquet(f"{path}/carry/{number}")
