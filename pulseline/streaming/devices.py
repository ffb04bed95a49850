"""What is kept per device, as steps over slices (see ``streaming.stepwise``).

The same answers as from per-device state in Python (``streaming.keyed``, ``streaming.facts``), but a slice and what the ones
before have left of each device are a batch: no worker is asked device by device.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseline.functions.temporal import duration, micros
from pulseline.operators.evaluation import deepest, whole_value
from pulseline.operators.liveness import silence_steps, stages
from pulseline.operators.skew import DEFAULT, Budget, attached, with_previous
from pulseline.sources.rules import EvalRule
from pulseline.streaming.facts import Watch
from pulseline.streaming.stepwise import Step

SILENCE_CARRY = "user_id BIGINT, ts TIMESTAMP, event_id BIGINT, given INT"
FACTS_CARRY = "user_id BIGINT, role STRING, event_type STRING, at BIGINT, event_id BIGINT, whole BIGINT"


def silence_step(tick: str = "1 second", budget: Budget = DEFAULT) -> Step:
    """The stages of silences, as ``liveness.liveness_steps`` has them, each with the slice after which it is due.

    A device's last event is carried, with how many stages of the silence after it have been given.
    """

    def step(events: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = events.where(F.col("ts").isNotNull()).select("user_id", "ts", "event_id", F.lit(0).alias("given"))
        known = before.unionByName(new)
        beats = with_previous(known, ["ts", "given"], ["user_id"], budget=budget).where(F.col("prev_1").isNotNull())
        between = beats.select("user_id", F.col("prev_1.ts").alias("last_seen"), F.col("ts").alias("until"), "prev_1.given")
        last = known.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "given")).alias("last")).select("user_id", "last.*")
        now = F.lit(known.agg(F.max("ts")).first()[0]).cast("timestamp")
        trailing = last.select("user_id", F.col("ts").alias("last_seen"), now.alias("until"), "given")
        silences = between.unionByName(trailing)
        rows = silences.select("user_id", "last_seen", F.inline(stages(tick, F.col("last_seen"), F.col("until"), F.col("given"))))
        quiet = micros(now) - micros(F.col("ts"))
        given = reduce(lambda a, b: a + b, [(quiet >= after).cast("int") for after, _, _ in silence_steps(tick)])
        return rows, last.withColumn("given", given)

    return step


def facts_step(rules: list[EvalRule], watched: list[Watch], types: list[str]) -> Step:
    """The facts that ``facts.device_facts`` keeps, carried as rows; the step's rows say how many events a device has had.

    ``role`` tells what a row is kept for: ``last``, the last time of a type; ``sample``, one of the newest samples; ``recent``,
    an event that a lookback from the newest anchor, or from one still to come, can reach.
    """
    depth = {e: deepest([r for r in rules if r.event == e]) for e in {r.event for r in rules}}
    kinds = sorted({kind for _, kind, _ in watched})
    anchors = sorted({anchor for anchor, _, _ in watched})
    wanted = sorted({*depth, *types, *kinds, *anchors})

    def step(events: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = events.where(F.col("event_type").isin(wanted) & F.col("ts").isNotNull()).select(
            "user_id", "event_type", micros(F.col("ts")).alias("at"), "event_id", whole_value().alias("whole")
        )
        counts = new.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        newest = new.agg(F.max("at")).first()[0]
        if newest is None:
            return counts, before
        kept = lambda role: before.where(F.col("role") == role).select(*new.columns)
        last = kept("last").unionByName(new).groupBy("user_id", "event_type").agg(F.max("at").alias("at"))
        samples = kept("sample").unionByName(new.where(F.col("event_type").isin(list(depth)) & F.col("whole").isNotNull()))
        order = Window.partitionBy("user_id", "event_type").orderBy(F.desc("at"), F.desc("event_id"))
        samples = samples.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(depth.values(), default=0))
        for kind, n in depth.items():
            samples = samples.where((F.col("event_type") != kind) | (F.col("_rank") <= n))
        tops = last.where(F.col("event_type").isin(anchors)).groupBy("user_id")
        tops = tops.agg(*[F.max(F.when(F.col("event_type") == a, F.col("at"))).alias(f"_top{i}") for i, a in enumerate(anchors)])
        recent = attached(kept("recent").unionByName(new.where(F.col("event_type").isin(kinds))), tops, ["user_id"])
        reached = []
        for anchor, kind, within in watched:
            top, far = F.col(f"_top{anchors.index(anchor)}"), duration(within)
            near = F.coalesce(F.col("at").between(top - far, top), F.lit(False))
            reached.append((F.col("event_type") == kind) & (near | (F.col("at") >= newest - far)))
        recent = recent.where(reduce(or_, reached, F.lit(False)))
        blank = F.lit(None).cast("bigint")
        parts = {"last": last.withColumns({"event_id": blank, "whole": blank}), "sample": samples, "recent": recent}
        named = [rows.withColumn("role", F.lit(role)).select(*before.columns) for role, rows in parts.items()]
        return counts, reduce(DataFrame.unionByName, named)

    return step


def facts_of(carry: DataFrame) -> DataFrame:
    """The carried facts as one row per device: ``last``, ``newest`` and ``recent``, as ``facts.kept`` has them."""
    event = F.struct("event_type", "at", "event_id")
    of = lambda role, value: F.collect_list(F.when(F.col("role") == role, value))
    gathered = carry.groupBy("user_id").agg(
        F.map_from_entries(of("last", F.struct("event_type", "at"))).alias("last"),
        F.sort_array(of("sample", F.struct("at", "event_id", "event_type", "whole")), asc=False).alias("newest"),
        of("recent", event).alias("recent"),
    )
    plain = lambda s: F.struct(*[s[c].alias(c) for c in ("event_type", "at", "event_id", "whole")])
    return gathered.withColumn("newest", F.transform("newest", plain))
