"""Per-device streaming operators that depend on the order of events.

Each works in two steps. First the events of a device are gathered into short time bins by an
ordinary windowed aggregate, which waits for the watermark, spreads even a hot device over many
tasks, and leaves a few rows per device and bin. Only those reach the per-device state, which
carries what it must from bin to bin. Bins come out in watermark order, so it is enough to sort
the rows of one trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.functions.geo import metres
from pulseline.functions.temporal import at, duration, micros
from pulseline.operators.evaluation import whole_value
from pulseline.operators.geo import fence_distance
from pulseline.sources.rules import Fence
from pulseline.operators.liveness import silence_steps
from pulseline.streaming.processors import CarryNewest, CarryPrevious, CountSilence


def _binned(df: DataFrame, device: str, width: str, value: Column, kind: str = "double") -> DataFrame:
    """One row per device and bin, with the bin's samples in time order."""
    sample = F.struct("ts", "event_id", value.cast(kind).alias("value"))
    bins = F.window("ts", f"{duration(width)} microseconds")
    return df.groupBy(device, bins.alias("bin")).agg(F.sort_array(F.collect_list(sample)).alias("samples"))


def stream_previous(
    df: DataFrame,
    value: Column,
    keep: Callable[[Column, Column], Column],
    device: str = "user_id",
    bin_width: str = "1 minute",
) -> DataFrame:
    """Samples for which ``keep(value, previous value of the device)`` holds, on a stream.

    Inside a bin the predecessor is at hand; only a bin's first and last samples, and those kept,
    travel on to the per-device state. ``previous`` is NULL for a device's first sample.
    """
    bins = _binned(df, device, bin_width, value).select(
        device, F.size("samples").alias("_n"), F.posexplode("samples").alias("_i", "_s"), "samples"
    )
    previous = F.try_element_at("samples", F.col("_i"))["value"]
    flat = bins.select(
        F.col(device).alias("device"),
        "_s.*",
        F.when(F.col("_i") > 0, previous).alias("previous"),
        (F.col("_i") == 0).alias("is_first"),
        (F.col("_i") == F.col("_n") - 1).alias("is_last"),
    )
    edges = F.col("is_first") | F.col("is_last")
    kind = df.schema[device].dataType.simpleString()
    carried = (
        flat.where(edges | keep(F.col("value"), F.col("previous")))
        .groupBy("device")
        .transformWithStateInPandas(
            CarryPrevious(),
            f"device {kind}, ts TIMESTAMP, event_id BIGINT, value DOUBLE, previous DOUBLE",
            "append",
            "none",
        )
    )
    return carried.where(keep(F.col("value"), F.col("previous"))).withColumnRenamed("device", device)


def stream_geofence_transitions(
    df: DataFrame, fence: Fence, device: str = "user_id", bin_width: str = "1 minute"
) -> DataFrame:
    """Devices entering or leaving the fence; before its first fix a device is outside.

    A malformed fix (a NULL coordinate) says nothing.
    """
    is_in = (fence_distance(fence) <= metres(fence.radius)).cast("double")
    moved = stream_previous(
        df.where(is_in.isNotNull()), is_in, lambda now, before: now != F.coalesce(before, F.lit(0.0)), device, bin_width
    )
    kind = F.when(F.col("value") == 1, F.lit("enter")).otherwise(F.lit("leave"))
    return moved.select(device, "ts", "event_id", kind.alias("transition"))


def stream_threshold_cross_up(
    df: DataFrame, threshold: float, device: str = "user_id", bin_width: str = "1 minute"
) -> DataFrame:
    """Samples above a threshold whose predecessor on the same device was below it."""
    crossed = stream_previous(
        df,
        F.col("value"),
        lambda now, before: (now > threshold) & (before < threshold),
        device,
        bin_width,
    )
    return crossed.select(
        device, "event_id", "ts", F.col("previous").alias("low"), F.col("value").alias("high")
    )


def stream_average_of_last(
    df: DataFrame, event_type: str, n: int, device: str = "user_id", bin_width: str = "1 minute"
) -> DataFrame:
    """Average of each device's newest ``n`` samples, one row per update.

    The average is NULL until there are ``n`` samples. Values and average are cut toward zero;
    a value that is NULL or beyond 64 bits is no sample.
    """
    whole = whole_value()
    series = df.where((F.col("event_type") == event_type) & whole.isNotNull())
    bins = _binned(series, device, bin_width, whole, "bigint").select(
        F.col(device).alias("device"),
        F.col("bin.end").alias("bin_end"),
        F.transform(
            F.slice("samples", F.greatest(F.size("samples") - n + 1, F.lit(1)), n),
            lambda s: s["value"],
        ).alias("newest"),
    )
    kind = df.schema[device].dataType.simpleString()
    return (
        bins.groupBy("device")
        .transformWithStateInPandas(
            CarryNewest(n),
            f"device {kind}, as_of TIMESTAMP, n INT, average BIGINT",
            "append",
            "none",
        )
        .withColumnRenamed("device", device)
    )


def stream_liveness_steps(df: DataFrame, tick: str = "1 second", device: str = "user_id") -> DataFrame:
    """The stages of each device's silences, as ``liveness.liveness_steps`` has them, as soon as they are due.

    A device's state is the time of its last event and the stage given last; a timer on event time waits for the
    next one, and any event sets it back. Only times are gathered in a micro-batch, no events.
    """
    kind = df.schema[device].dataType.simpleString()
    found = (
        df.where(F.col("ts").isNotNull())
        .select(F.col(device).alias("device"), "ts", micros(F.col("ts")).alias("at"))
        .groupBy("device")
        .transformWithStateInPandas(
            CountSilence(silence_steps(tick)),
            f"device {kind}, last_at BIGINT, since_at BIGINT, status STRING, lost_time INT",
            "append",
            "EventTime",
        )
    )
    return found.select(
        F.col("device").alias(device), at(F.col("last_at")).alias("last_seen"), at(F.col("since_at")).alias("since"), "status", "lost_time"
    )
