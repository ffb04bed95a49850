"""Event sequences: consecutive steps, the windowed state machine, and last-seen order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.functions.temporal import at, bin_of, duration, micros
from pulseline.operators.filters import last_seen
from pulseline.operators.skew import DEFAULT, Budget, with_previous

Steps = list[str | list[str]]


def step_types(steps: Steps) -> list[list[str]]:
    return [[s] if isinstance(s, str) else list(s) for s in steps]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _place(ts: str, tie: str) -> list[Column]:
    """Time and row id under fixed names."""
    names = {"event_id": tie, "ts": ts}
    return [F.col(c) if c == name else F.col(c).alias(name) for name, c in names.items()]


def match_sequence(
    df: DataFrame,
    steps: Steps,
    within: str | None,
    partition_by: tuple[str, ...] = (),
    ts: str = "ts",
    tie: str = "event_id",
    budget: Budget = DEFAULT,
) -> DataFrame:
    """Strictly consecutive events of the given types, one row per match.

    A step is a type or a list of types. Each step follows the one before within ``within``
    (inclusive). Without ``partition_by`` the order is that of the whole input. Columns:
    ``step_i_id`` and ``step_i_ts``.
    """
    wanted = step_types(steps)
    count = len(wanted)
    rows = df.select(*partition_by, *_place(ts, tie), "event_type")
    chained = with_previous(
        rows, ["event_id", "ts", "event_type"], list(partition_by), count - 1, budget=budget
    )
    at_step = [F.col(f"prev_{count - 1 - i}") for i in range(count - 1)]
    at_step.append(F.struct("event_id", "ts", "event_type"))
    conditions = [s["event_type"].isin(types) for s, types in zip(at_step, wanted)]
    if within is not None:
        bound = duration(within)
        conditions += [
            micros(b["ts"]) - micros(a["ts"]) <= bound for a, b in zip(at_step, at_step[1:])
        ]
    out = chained.where(all_of(conditions))
    columns = []
    for i, s in enumerate(at_step, 1):
        columns += [s["event_id"].alias(f"step_{i}_id"), s["ts"].alias(f"step_{i}_ts")]
    return out.select(*partition_by, *columns)


def sequence_fsm(
    df: DataFrame,
    steps: tuple[str, str, str, str],
    size: str,
    slide: str,
    ts: str = "ts",
    tie: str = "event_id",
    budget: Budget = DEFAULT,
) -> DataFrame:
    """Progress of A, B, C, D in each hopping window, over events of these four types only.

    One row per window and event at which the window's state is 3 (the last three events in the
    window are A, B, C) or 4 (A, B, C, D came before or now; the state stays).

    The run that ends at an event is the same in every window that holds the run, so it is found
    once over the global order; windows only decide whether the run starts inside them.
    """
    a, b, c, d = [s.lower() for s in steps]
    size_us, slide_us = duration(size), duration(slide)
    if size_us % slide_us:
        raise ValueError("size must be a multiple of slide")
    per_event = size_us // slide_us
    rows = df.where(F.lower("event_type").isin(a, b, c, d)).select(*_place(ts, tie), "event_type")
    chained = with_previous(rows, ["ts", "event_type"], k=3, budget=budget)

    def run(*types: str) -> Column:
        back = [f"prev_{n}.event_type" for n in range(len(types) - 1, 0, -1)]
        return all_of([F.lower(kind) == t for kind, t in zip([*back, "event_type"], types)])

    events = chained.select(
        "ts",
        "event_id",
        bin_of(F.col("ts"), slide_us).alias("_pane"),
        F.when(run(a, b, c), bin_of(F.col("prev_2.ts"), slide_us)).alias("_abc_from"),
        F.when(run(a, b, c, d), bin_of(F.col("prev_3.ts"), slide_us)).alias("_abcd_from"),
    )
    first_window = F.col("_pane") - (per_event - 1)
    # The first complete run of each window; then, per pane, those of all windows over it.
    complete = (
        events.where(F.col("_abcd_from") >= first_window)
        .withColumn("_w", F.explode(F.sequence(first_window, F.col("_abcd_from"))))
        .groupBy("_w")
        .agg(F.min(F.struct("ts", "event_id")).alias("_done"))
    )
    by_pane = (
        complete.withColumn("_pane", F.explode(F.sequence(F.col("_w"), F.col("_w") + per_event - 1)))
        .groupBy("_pane")
        .agg(F.map_from_entries(F.collect_list(F.struct("_w", "_done"))).alias("_done"))
    )
    here = F.struct("ts", "event_id")
    states = (
        events.join(by_pane, "_pane", "left")
        .where(F.col("_done").isNotNull() | (F.col("_abc_from") >= first_window))
        .withColumn("_w", F.explode(F.sequence(first_window, F.col("_pane"))))
        .withColumn("_first", F.try_element_at("_done", F.col("_w")))
        .withColumn(
            "state",
            F.when(here >= F.col("_first"), F.lit(4)).when(F.col("_w") <= F.col("_abc_from"), F.lit(3)),
        )
        .where(F.col("state").isNotNull())
    )
    return states.select(
        at(F.col("_w") * slide_us).alias("window_start"),
        at(F.col("_w") * slide_us + size_us).alias("window_end"),
        "ts",
        "event_id",
        "state",
    )


def last_seen_order(
    df: DataFrame, patterns: list[list[str]], device: str = "user_id", ts: str = "ts", max_gap: str | None = None
) -> DataFrame:
    """Devices whose newest events of each type are in pattern order; equal times pass.

    All types must have been seen. All patterns share one pass over the events. ``max_gap``
    bounds the time between neighbours.
    """
    types = sorted({t for p in patterns for t in p})
    newest = last_seen(df.where(F.col("event_type").isin(types)), types, device, ts)
    return in_pattern_order(newest, patterns, device, max_gap)


def in_pattern_order(
    newest: DataFrame, patterns: list[list[str]], device: str = "user_id", max_gap: str | None = None
) -> DataFrame:
    """The same from a table of last times, as ``filters.last_seen`` gives it or a stream keeps it."""

    def verdict(pattern: list[str]) -> Column:
        seen = [F.col(f"last_{t}") for t in pattern]
        steps = [x <= y for x, y in zip(seen, seen[1:])]
        if max_gap is not None:
            steps += [micros(y) - micros(x) <= duration(max_gap) for x, y in zip(seen, seen[1:])]
        return F.struct(
            F.lit(",".join(pattern)).alias("pattern"),
            all_of(steps or [seen[0].isNotNull()]).alias("_ok"),
            seen[0].alias("first_ts"),
            seen[-1].alias("last_ts"),
        )

    return (
        newest.select(device, F.inline(F.array(*[verdict(p) for p in patterns])))
        .where(F.col("_ok"))
        .drop("_ok")
    )
