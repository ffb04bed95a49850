"""Value rules over the newest samples of each series, and threshold crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.operators.skew import DEFAULT, Budget, with_previous
from pulseline.sources.rules import ABOVE_SAMPLES, EvalRule, rule_column


def whole_value(value: str = "value") -> Column:
    """A sample as a whole number, cut toward zero; NULL if it is NULL or beyond 64 bits.

    The rules take such a sample for none: it is neither tested nor counted.
    """
    return F.col(value).try_cast("bigint")


def newest(
    df: DataFrame, n: int, keys: list[str], ts: str = "ts", tie: str = "event_id"
) -> DataFrame:
    """The newest ``n`` rows per key. Spark cuts each map task's share to n rows first."""
    order = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def last_n_above(
    df: DataFrame, event_type: str, threshold: int, n: int = ABOVE_SAMPLES, device: str = "user_id"
) -> DataFrame:
    """Samples above a threshold among the newest ``n``: first the limit, then the test.

    Values count in whole numbers, cut toward zero.
    """
    series = df.where((F.col("event_type") == event_type) & whole_value().isNotNull())
    return (
        newest(series, n, [device])
        .withColumn("whole_value", whole_value())
        .where(F.col("whole_value") > threshold)
        .select(device, "event_id", "ts", "whole_value")
    )


def average_of_last(
    df: DataFrame, event_type: str, n: int, threshold: int, device: str = "user_id"
) -> DataFrame:
    """Devices whose average over exactly the newest ``n`` samples is below a threshold.

    Samples and average are whole numbers, cut toward zero.
    """
    series = df.where((F.col("event_type") == event_type) & whole_value().isNotNull())
    return (
        newest(series, n, [device])
        .groupBy(device)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(whole_value().cast("decimal(38,0)")).alias("_total"))
        .where(F.col("n") == n)
        .select(device, F.call_function("div", "_total", F.lit(n).cast("decimal(38,0)")).alias("average"))
        .where(F.col("average") < threshold)
    )


def evaluate_rules(df: DataFrame, rules: list[EvalRule], device: str = "user_id") -> DataFrame:
    """All evaluation rules in one pass over the events of their types.

    A ``>`` rule gives a row per sample above its threshold, an ``avg<`` rule one per device
    whose average is below it; ``measure`` is the sample or the average.
    """
    if not rules:
        raise ValueError("no rules")
    series = df.where(F.col("event_type").isin(sorted({r.event for r in rules})) & whole_value().isNotNull())
    ranked = newest(series, deepest(rules), [device, "event_type"])
    return judged(ranked.withColumn("whole", whole_value()), rules, device)


def deepest(rules: list[EvalRule]) -> int:
    """How many of the newest samples of a series the rules look at."""
    return max(r.samples for r in rules)


def judged(ranked: DataFrame, rules: list[EvalRule], device: str = "user_id") -> DataFrame:
    """What the rules say of the newest samples of each series: ``whole`` values with their ``rank``, 1 the newest."""
    ruled = (
        ranked.select(device, "event_id", "rank", F.col("whole").alias("_whole"), F.inline(rule_column(rules, F.col("event_type"))))
        .where(F.col("rank") <= F.col("samples"))
    )
    # Both kinds become one aggregate: ">" keeps each passing sample, "avg<" needs the sum.
    per_rule = ruled.groupBy("rule_id", "event", "sign", "samples", "threshold", device).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("_whole").cast("decimal(38,0)")).alias("_total"),
        F.collect_list(
            F.when(
                (F.col("sign") == ">") & (F.col("_whole") > F.col("threshold")),
                F.struct("event_id", F.col("_whole").alias("measure")),
            )
        ).alias("_above"),
    )
    average = F.call_function("div", F.col("_total"), F.col("samples").cast("decimal(38,0)"))
    below = F.when(
        (F.col("_n") == F.col("samples")) & (average < F.col("threshold")),
        F.array(F.struct(F.lit(None).cast("bigint").alias("event_id"), average.alias("measure"))),
    )
    hits = F.when(F.col("sign") == ">", F.col("_above")).when(F.col("sign") == "avg<", below)
    return per_rule.select("rule_id", "event", "sign", device, F.inline(hits))


def threshold_cross_up(
    df: DataFrame,
    threshold: float,
    keys: list[str],
    value: str = "value",
    ts: str = "ts",
    tie: str = "event_id",
    budget: Budget = DEFAULT,
) -> DataFrame:
    """Samples above a threshold whose predecessor in the same series was below it."""
    rows = df.select(*keys, ts, tie, value)
    crossed = with_previous(rows, [value], keys, 1, ts, tie, budget).where(
        (F.col(value) > threshold) & (F.col(f"prev_1.{value}") < threshold)
    )
    return crossed.select(
        *keys, tie, ts, F.col(f"prev_1.{value}").alias("low"), F.col(value).alias("high")
    )
