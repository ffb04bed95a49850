"""Alerts of all rules in one layout, and the two status reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.operators.alerts import all_alerts, as_alert
from pulseline.operators.filters import above
from pulseline.operators.geo import latest_location
from pulseline.plans import basics, patterns, places, timing
from pulseline.plans.registry import A, B, Query
from pulseline.sources.tables import events


def alerts_by_topic(spark: SparkSession, folder: str) -> DataFrame:
    """What all standing rules say, for publishing under their topics."""
    frequent = timing.freq_in_hop(spark, folder)
    followed = timing.a_then_b_in_hop(spark, folder)
    high = above(events(spark, folder), "value", 10)
    runs = patterns.seq_fsm_hop(spark, folder)
    near = places.proximity_named(spark, folder)
    fence = places.inside_fence_hop(spark, folder)
    window = ("window_start", "window_end")
    pair = F.concat_ws("-", "left_id", "right_id")
    return all_alerts(
        as_alert(frequent, "temporal-events", "frequency", F.col("event_type"), *window, F.col("n")),
        as_alert(followed, "temporal-events", "followed", F.lit(f"{A}-{B}"), *window, F.lit(1)),
        as_alert(high, "evaluation-events", "above", F.col("user_id"), "ts", "ts", F.col("value")),
        as_alert(runs, "sequence-events", "sequence", F.col("event_id"), *window, F.col("state")),
        as_alert(near, "geo-events", "near", pair, *window, F.col("distance")),
        as_alert(fence, "geo-events", "fence", F.lit("fence"), *window, F.col("distance")),
    )


def _line(df: DataFrame, section: str, rule, at, measure) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        rule.alias("rule"),
        "user_id",
        at.cast("timestamp").alias("at"),
        measure.cast("bigint").alias("measure"),
    )


def event_report(spark: SparkSession, folder: str) -> DataFrame:
    """Temporal, sequence and evaluation findings per device."""
    return report_lines(
        timing.lookback_b_before_a(spark, folder),
        timing.freq_lookback(spark, folder),
        patterns.seq_last_seen(spark, folder),
        basics.rule_table(spark, folder),
    )


def report_lines(hits: DataFrame, frequent: DataFrame, ordered: DataFrame, valued: DataFrame) -> DataFrame:
    """The lines of the event report, from the findings of its four rules."""
    none = F.lit(None)
    return all_alerts(
        _line(hits, "temporal", F.lit("b near a"), F.col("ts"), none),
        _line(frequent, "temporal", F.lit("a frequent"), F.col("anchor_ts"), F.col("n")),
        _line(ordered, "sequence", F.col("pattern"), F.col("last_ts"), none),
        _line(valued, "evaluation", F.concat_ws(" ", "event", "sign"), none, F.col("measure")),
    )


def geo_report(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of every device, and the devices around the detection point."""
    return positions_report(latest_location(places.located(spark, folder)))


def positions_report(positions: DataFrame) -> DataFrame:
    """The same from a table of newest positions, which a stream may keep up to date; in no order."""
    pairs, listed = places.near_pairs(positions), places.near_point(positions)
    return pairs.select(F.lit("pairs").alias("section"), "left_id", "right_id", "distance_m").unionByName(
        listed.select(
            F.lit("point").alias("section"),
            F.lit(None).cast("bigint").alias("left_id"),
            F.col("user_id").alias("right_id"),
            "distance_m",
        )
    )


def _sql(source: str, select: str) -> str:
    queries = {**basics.QUERIES, **timing.QUERIES, **patterns.QUERIES, **places.QUERIES}
    return f"SELECT {select} FROM ({queries[source].sql})"


def _alert_sql(source: str, topic: str, rule: str, subject: str, measure: str, span: str = "") -> str:
    span = span or "window_start AS valid_from, window_end AS valid_to"
    return _sql(
        source,
        f"'{topic}' AS topic, '{rule}' AS rule, CAST({subject} AS VARCHAR) AS subject, {span}, "
        f"CAST({measure} AS DOUBLE) AS measure",
    )


QUERIES = {
    "alerts_by_topic": Query(
        alerts_by_topic,
        " UNION ALL ".join(
            [
                _alert_sql("freq_in_hop", "temporal-events", "frequency", "event_type", "n"),
                _alert_sql("a_then_b_in_hop", "temporal-events", "followed", "'view-click'", "1"),
                """SELECT 'evaluation-events', 'above', CAST(user_id AS VARCHAR), ts, ts, value
                   FROM events WHERE value > 10""",
                _alert_sql("seq_fsm_hop", "sequence-events", "sequence", "event_id", "state"),
                _alert_sql("proximity_named", "geo-events", "near", "left_id || '-' || right_id", "distance"),
                _alert_sql("inside_fence_hop", "geo-events", "fence", "'fence'", "distance"),
            ]
        ),
    ),
    "event_report": Query(
        event_report,
        " UNION ALL ".join(
            [
                _sql(
                    "lookback_b_before_a",
                    "'temporal' AS section, 'b near a' AS rule, user_id, ts AS at, CAST(NULL AS BIGINT) AS measure",
                ),
                _sql("freq_lookback", "'temporal', 'a frequent', user_id, anchor_ts, n"),
                _sql("seq_last_seen", "'sequence', pattern, user_id, last_ts, NULL"),
                _sql("rule_table", "'evaluation', event || ' ' || sign, user_id, NULL, measure"),
            ]
        ),
    ),
    "geo_report": Query(
        geo_report,
        _sql("radius_pairs", "'pairs' AS section, left_id, right_id, distance_m")
        + " UNION ALL "
        + _sql("list_in_radius", "'point', NULL, user_id, distance_m"),
    ),
}
