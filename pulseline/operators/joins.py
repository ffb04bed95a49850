"""Joins on time: overlapping lifetimes, lookback from the last event, previous tick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.functions.temporal import at, bin_of, duration, interval, micros
from pulseline.operators.skew import DEFAULT, Budget, Within, salted_join, tiled_join


def _prefixed(df: DataFrame, prefix: str, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(
        *[F.col(c) if c in skip else F.col(c).alias(f"{prefix}{c}") for c in df.columns]
    )


def meet(
    left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, apart: int
) -> DataFrame:
    """Stream-stream equi join of events at most ``apart`` microseconds from each other.

    The bound on time tells Spark when a waiting row can be dropped from the state.
    """
    bound = interval(f"{apart} microseconds")
    near = (F.col(right_ts) >= F.col(left_ts) - bound) & (F.col(right_ts) <= F.col(left_ts) + bound)
    for c in on:
        near = near & (left[c] == right[c])
    pairs = left.join(right, near, "inner")
    for c in on:
        pairs = pairs.drop(right[c])
    return pairs


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    size: str,
    hop: str,
    on: tuple[str, ...] = (),
    ordered: bool = False,
    ts: str = "ts",
    tie: str = "event_id",
    budget: Budget = DEFAULT,
    since: int | None = None,
) -> DataFrame:
    """Pairs whose hop-snapped lifetimes of length ``size`` intersect.

    With L = size / hop, two lifetimes intersect exactly when their hop indices differ by less
    than L. The right row sits in one bucket of L hops and the left row looks in those it reaches, two or three, so the
    join is an equi join and every pair comes up once. ``ordered`` keeps only pairs whose right
    event is not before the left one, ``since`` only those with an event of that time (in microseconds) or later. On streams both sides need a watermark; a time bound next
    to the bucket lets Spark drop old state. Both ends of a lifetime are made once per event, in the type of ``ts``, not
    once per pair, and after the events were moved to where they meet.
    """
    size_us, hop_us = duration(size), duration(hop)
    if size_us % hop_us:
        raise ValueError("size must be a multiple of hop")
    hops = size_us // hop_us
    key = [*on, "_bucket"]

    def placed(side: DataFrame, df: DataFrame, prefix: str) -> DataFrame:
        hop = bin_of(F.col(f"{prefix}{ts}"), hop_us)
        ends = {"from": hop * hop_us, "to": hop * hop_us + size_us}
        kind = df.schema[ts].dataType
        return side.withColumns({f"{prefix}hop": hop, **{f"{prefix}{n}": at(end).cast(kind) for n, end in ends.items()}})

    def place_left(side: DataFrame) -> DataFrame:
        return placed(side, left, "left_")

    def place_right(side: DataFrame) -> DataFrame:
        return placed(side, right, "right_")

    home = bin_of(F.col(f"left_{ts}"), hop_us)
    first, last = (F.floor((home + step) / F.lit(hops)) for step in (1 - hops, hops - 1))
    looking = _prefixed(left, "left_", on).withColumn("_bucket", F.explode(F.sequence(first, last)))
    resting = _prefixed(right, "right_", on).withColumn("_bucket", bin_of(F.col(f"right_{ts}"), size_us))

    if left.isStreaming or right.isStreaming:
        pairs = meet(place_left(looking), place_right(resting), key, f"left_{ts}", f"right_{ts}", size_us + hop_us)
    else:
        within = Within(place_left, place_right)
        pairs = tiled_join(looking, resting, key, [f"left_{tie}"], [f"right_{tie}"], budget, within)

    pairs = pairs.where(F.abs(F.col("left_hop") - F.col("right_hop")) < hops)
    if ordered:
        pairs = pairs.where(F.col(f"right_{ts}") >= F.col(f"left_{ts}"))
    if since is not None:
        pairs = pairs.where(micros(F.greatest(f"left_{ts}", f"right_{ts}")) >= since)
    start, end = F.greatest("left_from", "right_from"), F.least("left_to", "right_to")
    return pairs.withColumns({"valid_from": start, "valid_to": end}).drop(
        "left_hop", "right_hop", "left_from", "right_from", "left_to", "right_to", "_bucket"
    )


def last_event(df: DataFrame, event_type: str, device: str = "user_id", ts: str = "ts") -> DataFrame:
    """Time of the newest event of a type, per device."""
    return df.where(F.col("event_type") == event_type).groupBy(device).agg(F.max(ts).alias("anchor_ts"))


def lookback(
    df: DataFrame,
    anchor: str,
    event_type: str,
    within: str,
    direction: str = "before",
    device: str = "user_id",
    ts: str = "ts",
    tie: str = "event_id",
    budget: Budget = DEFAULT,
) -> DataFrame:
    """Events of a type around the newest ``anchor`` event of the same device.

    ``before`` takes [anchor - within, anchor], ``after`` takes [anchor, anchor + within]; both
    ends belong to the range.
    """
    if direction not in ("before", "after"):
        raise ValueError(f"direction must be before or after, not {direction!r}")
    width = interval(within)
    low, high = (
        (F.col("anchor_ts") - width, F.col("anchor_ts"))
        if direction == "before"
        else (F.col("anchor_ts"), F.col("anchor_ts") + width)
    )
    hits = df.where(F.col("event_type") == event_type)
    found = salted_join(hits, last_event(df, anchor, device, ts), [device], [tie], budget=budget)
    return found.where(F.col(ts).between(low, high))


def frequency_lookback(
    df: DataFrame, event_type: str, n: int, within: str, device: str = "user_id"
) -> DataFrame:
    """Devices with at least ``n`` events of a type in the range that ends at the newest one."""
    return (
        lookback(df, event_type, event_type, within, device=device)
        .groupBy(device, "anchor_ts")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= n)
    )


def previous_tick(df: DataFrame, tick: str, threshold: float, value: str = "value") -> DataFrame:
    """Upward crossings in a regular series: above now, below exactly one tick before.

    Both comparisons are strict.
    """
    low = df.where(F.col(value) < threshold).select(
        (F.col(tick) + 1).alias(tick), F.col(value).alias("low")
    )
    high = df.where(F.col(value) > threshold).select(tick, F.col(value).alias("high"))
    return high.join(low, tick).select(tick, "low", "high")
