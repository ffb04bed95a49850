"""Running a stream over stored events to its end.

An append-mode query keeps its last windows open, because nothing tells it that time went on.
A replay therefore has a second, initially empty input folder. Once the events are through, one
marker event with a far-away time is put there and the query is started again on the same
checkpoint: the watermark passes every window, and no later event can be lost to it.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from pulseline.session import configure, work_dir

# Time and key of the marker event; it is never part of a result.
MARKER_TIME = datetime(2200, 1, 1)
MARKER_KEY = -1


def _marker(spark: SparkSession, like: DataFrame, **values) -> DataFrame:
    """One row with the columns of ``like``: the marker time and key, and NULL elsewhere."""
    known = {"ts": F.lit(MARKER_TIME), "user_id": F.lit(MARKER_KEY), "event_id": F.lit(MARKER_KEY)}
    known.update({k: F.lit(v) for k, v in values.items()})
    return spark.range(1).select(
        *[
            known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


class LateRowsDropped(RuntimeError):
    """A replay lost rows because the watermark had passed them."""


class Losses(threading.Thread):
    """Rows that the watermark dropped, of one query, however many batches it runs.

    A query remembers the progress of its last batches only (100, if not set otherwise), so it is asked
    again and again while it runs.
    """

    def __init__(self, query: StreamingQuery, every: float = 0.2):
        super().__init__(daemon=True)
        self.query, self.every, self.over = query, every, threading.Event()
        self.dropped: dict[tuple, int] = {}

    def look(self) -> None:
        for p in self.query.recentProgress:
            self.dropped[p.batchId, p.timestamp] = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def run(self) -> None:
        while not self.over.wait(self.every):
            self.look()

    def total(self) -> int:
        self.over.set()
        self.join()
        self.look()
        return sum(self.dropped.values())


def run_to_end(writer: DataStreamWriter, in_slices: bool = False) -> int:
    """Run a stream until its input is used up; returns how many rows the watermark dropped.

    A stream ``in_slices`` goes on from slice to slice until there are no more.
    """
    query = (writer if in_slices else writer.trigger(availableNow=True)).start()
    losses = Losses(query)
    losses.start()
    try:
        if in_slices:
            query.processAllAvailable()
            query.stop()
        query.awaitTermination()
    finally:
        lost = losses.total()
    return lost


def disorder(stored: DataFrame) -> str:
    """A watermark delay that covers any order in which the stored events may be read."""
    span = stored.agg((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span")).first()["span"]
    return f"{-(-(span or 0) // 1000)} milliseconds"


def _append(query: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    writer = query.writeStream.format("parquet").outputMode("append")
    return writer.option("path", out).option("checkpointLocation", checkpoint)


def replay(
    spark: SparkSession,
    source: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    name: str,
    watermark: str = "0 seconds",
    close: bool | datetime = True,
    lossless: bool = True,
    in_slices: bool = False,
    **marker,
) -> DataFrame:
    """Run ``build`` over a stream of stored events and return everything it emitted.

    The stream runs while the query is being built; the result is a table of what it wrote.
    ``watermark`` must cover the disorder in which the files may be read (see ``disorder``); a source
    ``in_slices`` of time has none. If rows are dropped all the same, a ``lossless`` replay fails. ``close`` sends the marker, so that
    open windows come out too, or a marker of the time given; ``marker`` fills further
    columns of it where a filter would drop it.
    """
    configure(spark)
    folder = work_dir(spark, name)
    out, checkpoint, closing = (f"{folder}/{part}" for part in ("out", "checkpoint", "closing"))
    marker_row = _marker(spark, source, **marker)
    if isinstance(close, datetime):
        marker_row = marker_row.withColumn("ts", F.lit(close))
    marker_row.limit(0).write.parquet(closing)
    late = spark.readStream.schema(marker_row.schema).parquet(closing)
    stream = source.unionByName(late).withWatermark("ts", watermark)
    result = build(stream)
    lost = run_to_end(_append(result, out, checkpoint), in_slices)
    if close:
        marker_row.write.mode("append").parquet(closing)
        lost += run_to_end(_append(result, out, checkpoint), in_slices)
    if lossless and lost:
        raise LateRowsDropped(f"{name}: {lost} rows came after the watermark")
    return spark.read.schema(result.schema).parquet(out)
