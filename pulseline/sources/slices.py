"""Stored events as a stream in the order of time.

A file stream reads files in the order they were written, so a watermark has to wait as long as all events
span, and a stateful query keeps all of them. Here a streaming data source gives one slice of event time per
micro-batch: all of a slice's events, wherever they are stored, and never one before it. A watermark without
delay loses nothing then, and state holds what one slice and the open windows need.

The plan is made from Parquet footers: a manifest of row groups with their smallest and largest time, and
cuts between slices of about equally many rows. A micro-batch reads the row groups that reach into its slice. Where
files overlap in time, a row group is read for each slice it reaches into; events that are stored in no order at all
should be written once in the order of time.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Send the reader to workers by value: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "pulseline_time_slices"
# Rows of a slice, rows of a task, and the steps of time that cuts are made of.
SLICE_ROWS, TASK_ROWS, STEPS = 50_000_000, 1_000_000, 1 << 16
# Points that stand for the rows of one row group.
POINTS = 16


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or ":/" in uri else f"file://{uri}")


def readable(uri: str, there: bool = True) -> bool:
    """Whether the store of a path opens without Spark, as a Python data source needs it, and (if asked) has the path."""
    try:
        store, path = opened(uri)
        return not there or store.get_file_info(path).type != pafs.FileType.NotFound
    except (pa.ArrowException, OSError, ValueError):
        return False


def micros_of(value) -> int:
    if isinstance(value, datetime) and value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return int(np.datetime64(value, "us").astype(np.int64))


def footer(uri: str, time: str) -> Iterator[tuple]:
    """(row group, first, last, rows, nulls) of a file; first and last are None if its footer tells no times."""
    store, path = opened(uri)
    with store.open_input_file(path) as file:
        meta = pq.ParquetFile(file).metadata
    at = meta.schema.to_arrow_schema().get_field_index(time)
    column = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == time) if at >= 0 else None
    for group in range(meta.num_row_groups):
        rows = meta.row_group(group)
        stats = rows.column(column).statistics if column is not None else None
        known = stats is not None and stats.has_min_max
        nulls = stats.null_count if stats is not None and stats.has_null_count else rows.num_rows
        yield group, *((micros_of(stats.min), micros_of(stats.max)) if known else (None, None)), rows.num_rows, nulls


def make_plan(spark: SparkSession, files: list[str], folder: str, time: str = "ts", slice_rows: int = SLICE_ROWS) -> list[int]:
    """Write the manifest of ``files`` below ``folder`` and return the cuts between slices, in microseconds.

    Footers are read by tasks. The driver sees one count per step of time, of which there are ``STEPS``.
    """

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["file"]:
                rows = [(uri, *row) for row in footer(uri, time)]
                yield pd.DataFrame(rows, columns=["file", "row_group", "first", "last", "n", "nulls"]).astype(
                    {"first": "Int64", "last": "Int64"}
                )

    named = spark.createDataFrame([(f,) for f in files], "file string")
    named = named.repartition(max(1, min(len(files), 1_000)))
    path = f"{folder}/manifest"
    layout = "file string, row_group int, first bigint, last bigint, n bigint, nulls bigint"
    named.mapInPandas(footers, layout).sortWithinPartitions("first").write.mode("overwrite").parquet(path)
    groups = spark.read.schema(layout).parquet(path).where("first is not null")
    low, high = groups.agg(F.min("first"), F.max("last")).first()
    if low is None:
        return []
    step = max(1, -(-(high - low + 1) // STEPS))
    point = F.col("first") + F.expr(f"cast((last - first) * ((i + 0.5D) / {POINTS}) as bigint)")
    spread = groups.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))))
    at = F.call_function("div", point - F.lit(low).cast("bigint"), F.lit(step).cast("bigint"))
    counts = spread.groupBy(at.alias("at")).agg((F.sum("n") / F.lit(POINTS)).alias("n")).orderBy("at").collect()
    cuts, held = [], 0.0
    for row in counts:
        if held and held + row["n"] > slice_rows:
            cuts.append(low + row["at"] * step)
            held = 0.0
        held += row["n"]
    return cuts


@dataclass
class Piece(InputPartition):
    """Row groups of one file, of which the rows of one slice are wanted."""

    file: str
    groups: list[int]
    after: int | None
    before: int | None


class TimeSlices(DataSource):
    """Options: ``plan`` (a folder made by ``slice_stream``), ``time`` (the column), ``run`` (a folder of one query)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: StructType) -> TimeSliceReader:
        return TimeSliceReader(self.options["plan"], self.options["run"], self.options.get("time", "ts"), schema)


class TimeSliceReader(DataSourceStreamReader):
    """An offset is how many slices have been given. Each question for the latest one offers one slice more.

    What was offered is written down first: a query that starts again never goes back behind its checkpoint,
    and at most finds several slices in one micro-batch.
    """

    def __init__(self, plan: str, run: str, time: str, schema: StructType):
        self.plan, self.run, self.time, self.schema = plan, run, time, schema
        store, path = opened(plan)
        with store.open_input_stream(f"{path}/slices.json") as file:
            self.cuts = json.loads(file.read())["cuts"]

    def initialOffset(self) -> dict:
        return {"slices": 0}

    def latestOffset(self) -> dict:
        store, path = opened(self.run)
        offered = 0
        if store.get_file_info(f"{path}/offered").type == pafs.FileType.File:
            with store.open_input_stream(f"{path}/offered") as file:
                offered = int(file.read())
        if offered <= len(self.cuts):
            offered += 1
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/offered") as file:
                file.write(str(offered).encode())
        return {"slices": offered}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["slices"], end["slices"]
        if first >= last:
            return []
        after = self.cuts[first - 1] if first else None
        before = self.cuts[last - 1] if last <= len(self.cuts) else None
        store, path = opened(f"{self.plan}/manifest")
        wanted = None
        if before is not None:
            wanted = (pc.field("first") < before) | pc.field("first").is_null() | (pc.field("nulls") > 0)
        table = pq.read_table(path, filesystem=store, filters=wanted)
        out: list[InputPartition] = []
        rows = zip(*(table[c].to_pylist() for c in ("file", "row_group", "first", "last", "n", "nulls")))
        held = 0
        for file, group, low, high, n, nulls in sorted(rows, key=lambda r: r[:2]):
            known = low is not None
            reaches = not known or ((before is None or low < before) and (after is None or high >= after))
            # Rows without a time come with the first slice.
            if not (reaches or (nulls and after is None)):
                continue
            if not out or out[-1].file != file or held + n > TASK_ROWS:
                out.append(Piece(file, [], after, before))
                held = 0
            out[-1].groups.append(group)
            held += n
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.groups:
            return
        store, path = opened(partition.file)
        names = self.schema.fieldNames()
        layout = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in self.schema.fields])
        with store.open_input_file(path) as file:
            source = pq.ParquetFile(file)
            held = set(source.schema_arrow.names)
            for batch in source.iter_batches(row_groups=partition.groups, columns=[n for n in names if n in held]):
                at = batch[self.time].cast(pa.timestamp("us")).cast(pa.int64())
                keep = pc.fill_null(pc.greater_equal(at, partition.after), False) if partition.after is not None else None
                if partition.before is not None:
                    earlier = pc.fill_null(pc.less(at, partition.before), partition.after is None)
                    keep = earlier if keep is None else pc.and_(keep, earlier)
                rows = batch if keep is None else batch.filter(keep)
                if rows.num_rows:
                    columns = [
                        rows[n].cast(layout.field(n).type) if n in held else pa.nulls(rows.num_rows, layout.field(n).type)
                        for n in names
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=layout)

    def commit(self, end: dict) -> None:
        pass


def slice_stream(
    spark: SparkSession, table: DataFrame, folder: str, time: str = "ts", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """A table read from Parquet files, as a stream of time slices of about ``slice_rows`` rows.

    ``folder`` keeps the plan and how far the query has come; a query that is started again on the same checkpoint must
    be given the same folder. Run it with an ordinary trigger: ``availableNow`` would take the first slice only.
    """
    store, path = opened(folder)
    if store.get_file_info(f"{path}/slices.json").type == pafs.FileType.NotFound:
        store.create_dir(path, recursive=True)
        cuts = make_plan(spark, table.inputFiles(), folder, time, slice_rows)
        with store.open_output_stream(f"{path}/slices.json") as file:
            file.write(json.dumps({"cuts": cuts}).encode())
    spark.dataSource.register(TimeSlices)
    reader = spark.readStream.format(NAME).schema(table.schema)
    return reader.option("plan", folder).option("run", folder).option("time", time).load()
