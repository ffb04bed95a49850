"""Row filters and simple per-series reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.functions.temporal import interval
from pulseline.functions.text import one_of, parse_long, same_text, words


def of_types(df: DataFrame, *event_types: str) -> DataFrame:
    """Keep some event types, whatever their case."""
    return df.where(one_of(F.col("event_type"), event_types))


def of_series(df: DataFrame, event_types: list[str], device: Column, device_id) -> DataFrame:
    """Keep the series of one device with one or more types."""
    return df.where(F.col("event_type").isin(event_types) & (device == F.lit(device_id)))


def above(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """Strictly above a threshold."""
    return df.where(F.col(value) > threshold)


def text_above(df: DataFrame, value: str, threshold: int) -> DataFrame:
    """Messages whose text is a whole number above a threshold; other text drops out."""
    return df.where(parse_long(F.col(value)) > threshold)


def geo_messages(df: DataFrame, object_id: str | None = None) -> DataFrame:
    """Position messages, optionally of one object."""
    geo = df.where(same_text(F.col("key"), "geo"))
    if object_id is None:
        return geo
    return geo.where(same_text(F.element_at(words(F.col("value")), 1), object_id))


def registered(df: DataFrame, registry: DataFrame, device: str, known: bool = True) -> DataFrame:
    """Events of registered devices (or, with ``known=False``, of all others).

    The registry may be large: Spark broadcasts it only when it measures it as small.
    """
    return df.join(registry.select(device), device, "left_semi" if known else "left_anti")


def largest_per_instant(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One sample per key: the largest value wins."""
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def first_per_instant(df: DataFrame, keys: list[str], value: str = "value", tie: str = "event_id") -> DataFrame:
    """One sample per key: the first arrival wins."""
    return df.groupBy(*keys).agg(
        F.min_by(value, tie).alias(value), F.min(tie).alias(tie)
    )


def latest(df: DataFrame, keys: list[str], fields: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest row per key."""
    newest = F.max_by(F.struct(*fields), F.struct(ts, tie)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def retained(df: DataFrame, keep: str, as_of: Column | None = None, ts: str = "ts") -> DataFrame:
    """Events not older than ``keep``, counted back from ``as_of`` (by default the newest event, which is looked up first).

    The bound is a constant then, so row groups of older events are not read.
    """
    if as_of is None:
        as_of = F.timestamp_micros(F.lit(df.agg(F.unix_micros(F.max(ts))).first()[0]).cast("bigint"))
    return df.where(F.col(ts) >= as_of - interval(keep))


def last_seen(df: DataFrame, event_types: list[str], device: str = "user_id", ts: str = "ts") -> DataFrame:
    """Time of each device's newest event of each type, one column ``last_<type>`` per type."""
    return df.groupBy(device).agg(
        *[F.max(F.when(F.col("event_type") == t, F.col(ts))).alias(f"last_{t}") for t in event_types]
    )


def series_counts(df: DataFrame, event_types: list[str], device: str = "user_id") -> DataFrame:
    """Every device with every event type and its number of events, zeros included."""
    counts = df.groupBy(device).agg(
        *[F.count_if(F.col("event_type") == t).alias(t) for t in event_types]
    )
    entries = [F.struct(F.lit(t).alias("event_type"), F.col(t).alias("n")) for t in event_types]
    return counts.select(device, F.explode(F.array(*entries)).alias("s")).select(device, "s.*")


def registered_series(
    registry: DataFrame, df: DataFrame, event_types: list[str], device: str = "user_id"
) -> DataFrame:
    """Every registered device with every event type and its number of events, zeros included."""
    counts = series_counts(df, event_types, device)
    types = F.array(*[F.lit(t) for t in event_types])
    series = registry.select(device).distinct().select(device, F.explode(types).alias("event_type"))
    return series.join(counts, [device, "event_type"], "left").fillna(0, ["n"])
