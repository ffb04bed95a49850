"""Event sequences over a stream of slices, by automata that are composed.

A piece of the stream acts on an automaton as a table: for each state before it, the state after it. Tables
of pieces that follow each other compose to the table of both, in whatever groups that is done. So
pieces are folded by many tasks at once, each over its own stretch of time; the tables of a pane's pieces compose to the pane's, and
those of panes to what a window's automaton went through. From slice to slice only one state per open window is carried.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.functions.temporal import at, bin_of, duration, micros
from pulseline.operators.sequences import Steps, match_sequence, step_types
from pulseline.operators.skew import DEFAULT, Budget
from pulseline.streaming.stepwise import Step

# Send the fold to workers by value: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MATCH_CARRY = "event_id bigint, ts timestamp, event_type string"
FSM_CARRY = "window bigint, state int"
# The place of what was before a slice, in the order of panes.
BEFORE = -(1 << 62)


def states_after(symbols: np.ndarray, start: int, pattern: np.ndarray) -> np.ndarray:
    """The automaton's state after each symbol: how much of ``pattern`` the last symbols spell.

    It begins in state ``start``, that is after ``pattern[:start]``. A complete pattern is for good.
    """
    size = len(pattern)
    if start == size:
        return np.full(len(symbols), size, dtype=np.int8)
    whole = np.r_[pattern[:start], symbols]
    state = np.zeros(len(whole), dtype=np.int8)
    for n in range(1, min(size, len(whole)) + 1):
        hit = np.ones(len(whole) - n + 1, dtype=bool)
        for k in range(n):
            hit &= whole[k : len(whole) - n + 1 + k] == pattern[k]
        state[n - 1 :][hit] = n
    state = state[start:]
    complete = np.flatnonzero(state == size)
    if len(complete):
        state[complete[0] :] = size
    return state


def _folded(pattern: np.ndarray):
    size = len(pattern)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """States of a task's events, which come in order, by the state before the task's part of their pane."""
        pane, now, first = None, [], (0, 0)
        for batch in batches:
            panes = batch["pane"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, panes[1:] != panes[:-1]]) if len(panes) else []
            for a, b in zip(cuts, [*cuts[1:], len(panes)]):
                rows = batch.iloc[a:b]
                if panes[a] != pane:
                    pane, now = panes[a], list(range(size))
                    first = (rows["at"].iloc[0], rows["event_id"].iloc[0])
                symbols = rows["symbol"].to_numpy()
                paths = [states_after(symbols, s, pattern) for s in now]
                now = [int(p[-1]) for p in paths]
                yield pd.DataFrame(
                    {
                        "pane": rows["pane"],
                        "first_at": first[0],
                        "first_id": first[1],
                        "at": rows["at"],
                        "event_id": rows["event_id"],
                        "states": list(np.stack(paths, 1).astype(np.int32)),
                    }
                )

    return fold


def _then(before: Column, table: Column) -> Column:
    """The composition of two tables: where the second one leads from the states that the first one gives."""
    return F.transform(before, lambda s: table[s])


def fsm_step(steps: tuple[str, ...], size: str, slide: str) -> Step:
    """The progress of a sequence in each hopping window, as ``sequences.sequence_fsm`` has it, slice by slice.

    Rows come out with the slice of their event. No task holds the events of a window, or orders more than its
    stretch of time; what is carried is one state per open window.
    """
    size_us, slide_us = duration(size), duration(slide)
    if size_us % slide_us:
        raise ValueError("size must be a multiple of slide")
    per_event, kinds = size_us // slide_us, [s.lower() for s in steps]
    symbols = sorted(set(kinds))
    pattern = np.array([symbols.index(k) for k in kinds])
    done = len(pattern)
    fold = _folded(pattern)
    layout = "pane bigint, first_at bigint, first_id bigint, at bigint, event_id bigint, states array<int>"

    def step(events: DataFrame, carried: DataFrame) -> tuple[DataFrame, ...]:
        spark = events.sparkSession
        kind = F.lower("event_type")
        symbol = F.array_position(F.array(*[F.lit(s) for s in symbols]), kind).cast("int") - 1
        wanted = events.where(kind.isin(symbols)).select(
            bin_of(F.col("ts"), slide_us).alias("pane"), micros(F.col("ts")).alias("at"), "event_id", symbol.alias("symbol")
        )
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = wanted.repartitionByRange(parts, "at", "event_id").sortWithinPartitions("at", "event_id")
        folded = ordered.mapInPandas(fold, layout).persist()
        piece = F.struct("first_at", "first_id")
        # One table per piece: a task's part of a pane. A complete sequence stays complete.
        tables = folded.groupBy("pane", piece.alias("piece")).agg(F.max_by("states", F.struct("at", "event_id")).alias("leads"))
        tables = tables.withColumn("leads", F.concat("leads", F.array(F.lit(done))))
        pieces = F.sort_array(F.collect_list(F.struct("piece", "leads")))
        same = F.array(*[F.lit(s) for s in range(done + 1)])
        begin = F.struct(same.alias("leads"), F.array().cast("array<struct<piece:struct<first_at:bigint,first_id:bigint>,before:array<int>>>").alias("met"))
        composed = F.aggregate(
            "pieces",
            begin,
            lambda acc, t: F.struct(
                _then(acc["leads"], t["leads"]).alias("leads"),
                F.concat(acc["met"], F.array(F.struct(t["piece"].alias("piece"), acc["leads"].alias("before")))).alias("met"),
            ),
        )
        panes = tables.groupBy("pane").agg(pieces.alias("pieces")).select("pane", composed.alias("c")).select("pane", "c.*").persist()
        # What was carried acts on a window like a pane that leads from every state to the one carried.
        first_window = F.col("pane") - (per_event - 1)
        acting = panes.select(F.explode(F.sequence(first_window, F.col("pane"))).alias("window"), "pane", "leads").unionByName(
            carried.select("window", F.lit(BEFORE).alias("pane"), F.array_repeat("state", done + 1).alias("leads"))
        )
        through = F.aggregate(
            "acting",
            F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<pane:bigint,state:int>>").alias("met")),
            lambda acc, t: F.struct(
                t["leads"][acc["state"]].alias("state"),
                F.concat(acc["met"], F.array(F.struct(t["pane"].alias("pane"), acc["state"].alias("state")))).alias("met"),
            ),
        )
        windows = acting.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("pane", "leads"))).alias("acting"))
        windows = windows.select("window", through.alias("t")).select("window", "t.*").persist()
        open_panes = windows.select("window", F.explode("met").alias("m")).where(F.col("m.pane") != BEFORE)
        open_panes = open_panes.groupBy(F.col("m.pane").alias("pane")).agg(
            F.collect_list(F.struct("window", F.col("m.state").alias("state"))).alias("windows")
        )
        befores = panes.select("pane", F.inline("met"))
        here = folded.withColumn("piece", piece).join(befores, ["pane", "piece"]).join(open_panes, "pane")

        def state_in(w: Column) -> Column:
            reached = F.get("before", w["state"])
            return F.when(reached == done, F.lit(done)).otherwise(F.get("states", reached))

        hits = F.filter(
            F.transform("windows", lambda w: F.struct(w["window"].alias("window"), state_in(w).alias("state"))),
            lambda w: w["state"] >= done - 1,
        )
        hits = here.select("at", "event_id", F.inline(hits))
        rows = hits.select(
            at(F.col("window") * slide_us).alias("window_start"),
            at(F.col("window") * slide_us + size_us).alias("window_end"),
            at(F.col("at")).alias("ts"),
            "event_id",
            "state",
        )
        newest = events.agg(F.max(bin_of(F.col("ts"), slide_us))).first()[0]
        still_open = windows.select("window", "state")
        if newest is not None:
            still_open = still_open.where(F.col("window") > newest - per_event)
        return rows, still_open, folded, panes, windows

    return step


def match_step(steps: Steps, within: str | None, partition_by: tuple[str, ...] = (), budget: Budget = DEFAULT) -> tuple[Step, str]:
    """Strictly consecutive events, as ``sequences.match_sequence`` has them, slice by slice; and what it carries.

    Of the past a match needs the last events only, one fewer than it has steps (of each key): they are carried
    over, and each slice is matched behind them as a batch, which puts no key and no whole order into one task.
    """
    behind = len(step_types(steps)) - 1

    def step(events: DataFrame, carried: DataFrame) -> tuple[DataFrame, ...]:
        slim = events.select(*carried.columns).unionByName(carried)
        matches = match_sequence(slim, steps, within, partition_by, budget=budget)
        newest = [F.desc("ts"), F.desc("event_id")]
        if partition_by:
            place = F.row_number().over(Window.partitionBy(*partition_by).orderBy(*newest))
            last = slim.withColumn("place", place).where(F.col("place") <= behind).drop("place")
        else:
            last = slim.orderBy(*newest).limit(behind)
        return matches, last

    keys = "".join(f", {k} bigint" for k in partition_by)
    return step, MATCH_CARRY + keys
