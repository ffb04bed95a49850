"""Time arithmetic on event-time columns, in whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def duration(text: str) -> int:
    """Microseconds of a duration such as ``"90 seconds"`` or ``"1 hour 30 minutes"``."""
    parts = text.split()
    if not parts or len(parts) % 2:
        raise ValueError(f"not a duration: {text!r}")
    total = 0
    for number, unit in zip(parts[::2], parts[1::2]):
        unit = unit.lower().rstrip("s")
        if unit not in _UNIT_MICROS:
            raise ValueError(f"not a duration: {text!r}")
        total += int(number) * _UNIT_MICROS[unit]
    if total <= 0:
        raise ValueError(f"a duration must be positive: {text!r}")
    return total


def interval(text: str) -> Column:
    """The duration as an interval literal."""
    return F.expr(f"interval {duration(text)} microseconds")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def at(micros_col: Column) -> Column:
    return F.timestamp_micros(micros_col)


def bin_of(ts: Column, width: int) -> Column:
    """Index of the epoch-aligned bin of ``width`` microseconds holding ``ts``."""
    # pmod keeps it a floor before 1970 too, and div stays in whole numbers.
    value, w = micros(ts), F.lit(width).cast("bigint")
    return F.call_function("div", value - F.pmod(value, w), w)


def point_lifetime(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Point events: valid for the smallest time unit, one microsecond."""
    start = F.col(ts).cast("timestamp")
    return df.withColumns({"valid_from": start, "valid_to": at(micros(start) + 1)})


def interval_lifetime(df: DataFrame, length: str, ts: str = "ts") -> DataFrame:
    """Interval events valid over [ts, ts + length)."""
    start = F.col(ts).cast("timestamp")
    return df.withColumns({"valid_from": start, "valid_to": at(micros(start) + duration(length))})


def hop_lifetime(df: DataFrame, size: str, hop: str, ts: str = "ts") -> DataFrame:
    """Snap the start down to the hop grid and stay valid for ``size``; one row stays one row."""
    start = bin_of(F.col(ts), duration(hop)) * F.lit(duration(hop))
    return df.withColumns({"valid_from": at(start), "valid_to": at(start + duration(size))})


def shift_lifetime(df: DataFrame, by: str, length: str) -> DataFrame:
    """Move every lifetime by ``by`` and make it ``length`` long."""
    start = micros(F.col("valid_from")) + duration(by)
    return df.withColumns({"valid_from": at(start), "valid_to": at(start + duration(length))})


def plain_times(df: DataFrame) -> DataFrame:
    """Time-zone free output: every top-level TIMESTAMP column as TIMESTAMP_NTZ."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
