"""Aggregates over hopping windows."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.functions.temporal import at, bin_of, duration, micros

# name -> (aggregate over rows, how to merge partial results of a column, how to merge two of them)
Aggregate = tuple[Column, Callable[[str], Column], Callable[[Column, Column], Column]]
Aggregates = dict[str, Aggregate]


def count_rows() -> Aggregate:
    return F.count(F.lit(1)), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def smallest(value: Column) -> Aggregate:
    return F.min(value), F.min, F.least


def largest(value: Column) -> Aggregate:
    return F.max(value), F.max, F.greatest


def hop_aggregate(
    df: DataFrame,
    keys: list[str],
    size: str,
    slide: str,
    aggregates: Aggregates,
    ts: str = "ts",
) -> DataFrame:
    """Group by keys and epoch-aligned windows [start, start + size), one every ``slide``; empty ones do not come up.

    A batch is reduced to one row per key and pane, as wide as the greatest common divisor of size and slide. Panes are
    never copied into the windows over them. They are put into blocks as long as a window. A window
    then is the last panes of one block and the first ones of the next, so running aggregates from either end of
    a block answer all windows; between two panes that come or go they do not change, and windows are
    listed only from such stretches. A condition on the aggregates is tested before that.

    Streams use Spark's window function, which gives the same windows.
    """
    size_us, slide_us = duration(size), duration(slide)
    if df.isStreaming:
        window = F.window(ts, f"{size_us} microseconds", f"{slide_us} microseconds")
        grouped = df.groupBy(window, *keys).agg(*[rows.alias(name) for name, (rows, _, _) in aggregates.items()])
        return grouped.select(
            *keys,
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *aggregates,
        )
    unit = math.gcd(size_us, slide_us)
    length, step = size_us // unit, slide_us // unit
    panes = df.withColumn("_pane", bin_of(F.col(ts), unit)).groupBy(*keys, "_pane")
    panes = panes.agg(*[rows.alias(name) for name, (rows, _, _) in aggregates.items()])

    # For the windows that begin in a block, its own panes go one after the other, and those of the next block come.
    pane = F.col("_pane")
    block = F.call_function("div", pane - F.pmod(pane, F.lit(length)), F.lit(length).cast("bigint"))

    def change(of: Column, at_window: Column, goes: Column | None) -> Column:
        return F.struct(of.alias("_block"), at_window.alias("_from"), (F.lit(None) if goes is None else goes).cast("boolean").alias("_goes"))

    changes = F.array(
        change(block, pane + 1, F.lit(True)),
        change(block - 1, pane - length + 1, F.lit(False)),
        # The first stretch of each block.
        change(block, block * length, None),
        change(block - 1, (block - 1) * length, None),
    )
    moved = panes.withColumn("_c", F.explode(changes)).select(*keys, "_c.*", *aggregates).repartition(*keys, "_block")
    grouped = moved.groupBy(*keys, "_block", "_from").agg(
        *[
            merge(F.when(F.col("_goes") == goes, F.col(name))).alias(f"_{goes}_{name}")
            for name, (_, merge, _) in aggregates.items()
            for goes in (True, False)
        ]
    )
    along = Window.partitionBy(*keys, "_block")
    until_now = along.orderBy("_from").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    still_there = along.orderBy(F.desc("_from")).rowsBetween(Window.unboundedPreceding, -1)
    stretches = grouped.select(
        *keys,
        "_from",
        F.lead("_from", 1).over(along.orderBy("_from")).alias("_next"),
        ((F.col("_block") + 1) * length).alias("_end"),
        *[merge(f"_True_{name}").over(still_there).alias(f"_own_{name}") for name, (_, merge, _) in aggregates.items()],
        *[merge(f"_False_{name}").over(until_now).alias(f"_new_{name}") for name, (_, merge, _) in aggregates.items()],
    )
    # A stretch without panes has no partial result at all; a pane may well have none of one aggregate.
    live = stretches.select(
        *keys,
        # Windows begin at multiples of the step.
        (F.col("_from") + F.pmod(-F.col("_from"), F.lit(step))).alias("_from"),
        (F.coalesce("_next", "_end") - 1).alias("_to"),
        *[both(F.col(f"_own_{name}"), F.col(f"_new_{name}")).alias(name) for name, (_, _, both) in aggregates.items()],
    )
    some = reduce(or_, [F.col(name).isNotNull() if merge is not F.sum else F.col(name) > 0 for name, (_, merge, _) in aggregates.items()])
    windows = live.where(some & (F.col("_from") <= F.col("_to")))
    windows = windows.withColumn("_w", F.explode(F.sequence(F.col("_from"), F.col("_to"), F.lit(step).cast("bigint"))))
    return windows.select(
        *keys, at(F.col("_w") * unit).alias("window_start"), at(F.col("_w") * unit + size_us).alias("window_end"), *aggregates
    )


def event_frequency(
    df: DataFrame,
    event_type: str,
    n: int,
    size: str,
    slide: str,
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """Windows in which an event type occurs at least ``n`` times. Case does not matter."""
    hits = df.withColumn("event_type", F.lower("event_type")).where(
        F.col("event_type") == event_type.lower()
    )
    counted = hop_aggregate(hits, ["event_type", *partition_by], size, slide, {"n": count_rows()})
    return counted.where(F.col("n") >= n)


def snapshot_count(df: DataFrame, event_type: str, size: str, hop: str, n: int = 1) -> DataFrame:
    """How many events of a type are alive, one row per hop-long interval with at least ``n``.

    Each event lives for ``size`` from its hop-snapped start, so the events alive in [t, t + hop)
    are those of the window that ends at t + hop.
    """
    hits = df.where(F.col("event_type") == event_type)
    counted = hop_aggregate(hits, [], size, hop, {"n": count_rows()}).where(F.col("n") >= n)
    return counted.select(
        at(micros(F.col("window_end")) - duration(hop)).alias("valid_from"),
        F.col("window_end").alias("valid_to"),
        "n",
    )


def followed_within(
    df: DataFrame,
    first: str,
    then: str,
    size: str,
    slide: str,
    partition_by: tuple[str, ...] = (),
    ts: str = "ts",
    tie: str = "event_id",
) -> DataFrame:
    """Windows in which some ``then`` event comes after some ``first`` event.

    That holds when the earliest ``first`` precedes the latest ``then``: a minimum and a maximum,
    which merge before the shuffle.
    """
    kind = F.lower("event_type")
    place = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    found = hop_aggregate(
        df.where(kind.isin(first.lower(), then.lower())),
        list(partition_by),
        size,
        slide,
        {
            "first": smallest(F.when(kind == first.lower(), place)),
            "then": largest(F.when(kind == then.lower(), place)),
        },
        ts=ts,
    )
    return found.where(F.col("first") < F.col("then")).select(
        *partition_by,
        "window_start",
        "window_end",
        F.col("first.ts").alias("first_ts"),
        F.col("then.ts").alias("last_ts"),
    )


def nearest_to_point(
    df: DataFrame, distance: Column, size: str, slide: str, within: float
) -> DataFrame:
    """Windows whose smallest distance to a point is at most ``within``."""
    nearest = hop_aggregate(
        df.withColumn("_d", distance), [], size, slide, {"distance": smallest(F.col("_d"))}
    )
    return nearest.where(F.col("distance") <= within)
