"""Silent devices, and events that arrive out of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.functions.temporal import at, duration, interval, micros
from pulseline.operators.skew import DEFAULT, RANGE, Budget, in_ranges, with_previous


def status_rows(last_seen: Column, until: Column, over: str, fail: str) -> Column:
    """The states a silence from ``last_seen`` to ``until`` goes through, as an array."""
    silence = micros(until) - micros(last_seen)

    def state(name: str, after: str) -> Column:
        since = last_seen + interval(after)
        row = F.struct(F.lit(name).alias("status"), since.alias("since"))
        return F.when(silence >= duration(after), row)

    return F.array_compact(F.array(state("OVER", over), state("FAIL", fail)))


def device_liveness(
    df: DataFrame,
    over: str = "181 seconds",
    fail: str = "242 seconds",
    as_of: Column | None = None,
    device: str = "user_id",
    ts: str = "ts",
    tie: str = "event_id",
    budget: Budget = DEFAULT,
) -> DataFrame:
    """Silences of each device: ``OVER`` once one lasts ``over``, then ``FAIL`` after ``fail``.

    The silence after a device's last event counts up to ``as_of``, by default the newest event
    of any device; its rows have no ``next_seen``.
    """
    silences = _silences(df, as_of, device, ts, tie, budget)
    return silences.select(
        device,
        "last_seen",
        "next_seen",
        F.inline(status_rows(F.col("last_seen"), F.col("_until"), over, fail)),
    )


def _silences(df: DataFrame, as_of: Column | None, device: str, ts: str, tie: str, budget: Budget) -> DataFrame:
    """Every device's ``last_seen``, ``next_seen`` (NULL after its last event) and ``_until``, the silence's end so far."""
    if as_of is None:
        as_of = df.select(F.max(ts)).scalar()
    beats = with_previous(df.select(device, ts, tie), [ts], [device], 1, ts, tie, budget)
    between = beats.where(F.col("prev_1").isNotNull()).select(
        device, F.col(f"prev_1.{ts}").alias("last_seen"), F.col(ts).alias("next_seen")
    )
    trailing = df.groupBy(device).agg(F.max(ts).alias("last_seen")).withColumn(
        "next_seen", F.lit(None).cast("timestamp")
    )
    return between.unionByName(trailing).withColumn("_until", F.coalesce(F.col("next_seen"), as_of))


# Ticks of silence, the state they lead to, and how many ticks count as lost by then.
SILENCE_STEPS = [(60, "FULL", 1), (120, "FULL", 2), (180, "FULL", 3), (181, "OVER", 4), (242, "FAIL", 4), (243, "DISCONNECT", 0)]


def silence_steps(tick: str) -> list[tuple[int, str, int]]:
    """The stages of a silence as (microseconds, status, lost time)."""
    return [(n * duration(tick), status, lost) for n, status, lost in SILENCE_STEPS]


def stages(tick: str, last_seen: Column, until: Column, given: Column | None = None) -> Column:
    """The stages of a silence from ``last_seen`` to ``until``, as an array; without the first ``given`` ones."""
    length = micros(until) - micros(last_seen)
    found = []
    for i, (after, status, lost) in enumerate(silence_steps(tick)):
        due = length >= after if given is None else (length >= after) & (given <= i)
        since = at(micros(last_seen) + after).alias("since")
        found.append(F.when(due, F.struct(since, F.lit(status).alias("status"), F.lit(lost).alias("lost_time"))))
    return F.array_compact(F.array(*found))


def liveness_steps(
    df: DataFrame,
    tick: str = "1 second",
    as_of: Column | None = None,
    device: str = "user_id",
    ts: str = "ts",
    tie: str = "event_id",
    budget: Budget = DEFAULT,
) -> DataFrame:
    """All stages of all silences: ``last_seen``, ``since``, ``status`` and ``lost_time``.

    A silent device loses time at 60, 120, 180 and 181 ticks, is ``OVER`` at 181, ``FAIL`` at 242 and is disconnected,
    with nothing lost any more, at 243. Any event ends a silence. An event without a time is none.
    """
    silences = _silences(df.where(F.col(ts).isNotNull()), as_of, device, ts, tie, budget)
    return silences.select(device, "last_seen", F.inline(stages(tick, F.col("last_seen"), F.col("_until"))))


def flag_late(
    df: DataFrame, arrival: str, ts: str = "ts", tie: str = "event_id", budget: Budget = DEFAULT
) -> DataFrame:
    """Add ``late``: an event is late when an earlier arrival has a later event time.

    Arrivals are numbers in any range, with gaps and repeats; equal ones follow each other by ``tie``. An
    event without an arrival is never late and makes no other one late; nor does one without a time.

    The running maximum is taken in two steps: inside ranges of arrivals, which hold about as many rows as
    the budget says (see ``skew.in_ranges``), and over the maxima of the ranges before. Only those
    maxima, one row per range, pass through one task.
    """
    known = F.col(arrival).isNotNull()
    rest = df.where(~known).withColumn("late", F.lit(False))
    ranged = in_ranges(df.where(known), arrival, tie, budget)

    def late(high: Column) -> Column:
        return F.coalesce(F.col(ts) < high, F.lit(False))

    if ranged is None:
        along = Window.partitionBy(F.lit(0)).orderBy(arrival, tie).rowsBetween(Window.unboundedPreceding, -1)
        return df.where(known).withColumn("late", late(F.max(ts).over(along))).unionByName(rest)
    before = Window.orderBy(*RANGE).rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        ranged.groupBy(*RANGE).agg(F.max(ts).alias("_top")).select(*RANGE, F.max("_top").over(before).alias("_earlier"))
    )
    inside = Window.partitionBy(*RANGE).orderBy(arrival, tie).rowsBetween(Window.unboundedPreceding, -1)
    high = F.greatest("_earlier", F.max(ts).over(inside))
    flagged = (
        ranged.join(earlier, RANGE)
        .withColumn("late", late(high))
        .drop(*RANGE, "_earlier")
    )
    return flagged.unionByName(rest)


def drop_late(df: DataFrame, arrival: str, **options) -> DataFrame:
    """Keep only events that arrive in order."""
    return flag_late(df, arrival, **options).where(~F.col("late")).drop("late")


def require_order(df: DataFrame, arrival: str, ts: str = "ts", **options) -> DataFrame:
    """Fail the job at the first event that arrives out of order."""
    flagged = flag_late(df, arrival, ts=ts, **options)
    problem = F.raise_error(F.concat(F.lit("event out of order at "), F.col(ts).cast("string")))
    return flagged.where(F.when(F.col("late"), problem.cast("boolean")).otherwise(F.lit(True))).drop("late")
