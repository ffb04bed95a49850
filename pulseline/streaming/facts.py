"""Standing questions answered from a stream's state.

One stateful operator keeps, per device, the newest samples of the types that rules look at, the last time of each type, and
the events that lookback questions can still reach. Each micro-batch touches the devices it has events of, and
nothing else. Questions are put to that state through Spark's state reader, so an answer costs what the
state holds, not what the stream has brought.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.functions.temporal import at, duration, micros
from pulseline.operators.evaluation import deepest, judged, whole_value
from pulseline.sources.rules import EvalRule
from pulseline.streaming.processors import DeviceFacts

# (anchor type, type, how far back)
Watch = tuple[str, str, str]


def device_facts(
    df: DataFrame, rules: list[EvalRule], watched: list[Watch], types: list[str], device: str = "user_id"
) -> DataFrame:
    """Keep the facts that ``rules``, lookbacks ``watched`` and the last times of ``types`` need.

    The stream needs a watermark. Its rows say which device has had how many events in a micro-batch. An event without a
    time or a type tells nothing; a value that is NULL or beyond 64 bits is no sample.
    """
    depth = {e: deepest([r for r in rules if r.event == e]) for e in {r.event for r in rules}}
    wanted = sorted({*depth, *types, *(t for a, b, _ in watched for t in (a, b))})
    kind = df.schema[device].dataType.simpleString()
    # As text: whole numbers with gaps among them would pass through floating point.
    slim = df.where(F.col("event_type").isin(wanted) & F.col("ts").isNotNull()).select(
        F.col(device).alias("device"),
        "ts",
        "event_id",
        "event_type",
        micros(F.col("ts")).alias("at"),
        whole_value().cast("string").alias("whole"),
    )
    processor = DeviceFacts(depth, [(a, b, duration(t)) for a, b, t in watched])
    return slim.groupBy("device").transformWithStateInPandas(
        processor, f"device {kind}, n BIGINT", "append", "EventTime"
    ).withColumnRenamed("device", device)


def kept(spark: SparkSession, checkpoint: str, device: str = "user_id") -> DataFrame:
    """The facts of every device as of the last micro-batch: ``last``, ``newest``, ``recent``."""
    state = spark.read.format("statestore").option("stateVarName", "facts").load(checkpoint)
    return state.select(F.col("key.device").alias(device), "value.*")


def rules_now(facts: DataFrame, rules: list[EvalRule], device: str = "user_id") -> DataFrame:
    """What ``evaluation.evaluate_rules`` says, from the newest samples that are kept."""
    # Kept newest first; their place among those of the same type is the rank.
    samples = facts.select(device, "newest", F.posexplode("newest").alias("_i", "_s"))
    rank = F.size(F.filter(F.slice("newest", F.lit(1), F.col("_i") + 1), lambda s: s["event_type"] == F.col("_s.event_type")))
    ranked = samples.select(device, "_s.event_type", "_s.event_id", "_s.whole", rank.alias("rank"))
    return judged(ranked, rules, device)


def lookback_now(facts: DataFrame, anchor: str, event_type: str, within: str, device: str = "user_id") -> DataFrame:
    """What ``joins.lookback`` finds before each device's newest anchor."""
    top = F.try_element_at("last", F.lit(anchor))
    hits = F.filter(
        "recent", lambda e: (e["event_type"] == event_type) & (e["at"] <= top) & (e["at"] >= top - duration(within))
    )
    found = facts.select(device, at(top).alias("anchor_ts"), F.explode(hits).alias("e"))
    return found.select(device, "e.event_id", at(F.col("e.at")).alias("ts"), "anchor_ts")


def frequency_now(facts: DataFrame, event_type: str, n: int, within: str, device: str = "user_id") -> DataFrame:
    """What ``joins.frequency_lookback`` counts."""
    found = lookback_now(facts, event_type, event_type, within, device)
    return found.groupBy(device, "anchor_ts").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)


def last_seen_now(facts: DataFrame, types: list[str], device: str = "user_id") -> DataFrame:
    """What ``filters.last_seen`` gives."""
    return facts.select(device, *[at(F.try_element_at("last", F.lit(t))).alias(f"last_{t}") for t in types])
