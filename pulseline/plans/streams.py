"""Streaming twins: the event table read as a stream, run to its end."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.functions.temporal import duration
from pulseline.operators import windows
from pulseline.operators.filters import above, last_seen
from pulseline.operators.alerts import all_alerts, as_alert
from pulseline.operators.geo import box_pairs, fence_distance, named_proximity
from pulseline.operators.joins import overlap_join
from pulseline.operators.sequences import in_pattern_order
from pulseline.plans import basics, patterns, places, reports, timing
from pulseline.plans.registry import A, B, C, D, Query
from pulseline.session import shared_root, work_dir
from pulseline.sources import slices
from pulseline.sources.tables import events, events_stream, load, with_location
from pulseline.streaming import automata, changelog, devices, facts, keyed, sinks, stepwise, windowed
from pulseline.streaming.replay import disorder, replay, run_to_end

# Files per micro-batch of the streams of files; None takes all at once. The rows do not depend on it.
FILES_PER_BATCH: int | None = None


def source(spark: SparkSession, folder: str) -> DataFrame:
    return events_stream(spark, folder, FILES_PER_BATCH)


def sliced(spark: SparkSession, folder: str, rows: int | None = None) -> DataFrame:
    """The events as a stream of time slices."""
    stored = load(spark, folder, "events")
    stream = slices.slice_stream(spark, stored, work_dir(spark, "slices"), slice_rows=rows or slices.SLICE_ROWS)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def in_slices(spark: SparkSession, folder: str) -> bool:
    """Whether the event files and the work folder open outside Spark, as the slices need it."""
    return slices.readable(f"{folder.rstrip('/')}/events.parquet") and slices.readable(shared_root(spark), there=False)


def replayed(spark: SparkSession, folder: str, build, name: str, **options) -> DataFrame:
    """All that ``build`` emits over the stored events.

    They come in slices of time, so the watermark needs no delay and state stays small. In a store that only
    Spark opens, files come in whatever order they are read, and the watermark waits for all of them.
    """
    if in_slices(spark, folder):
        return replay(spark, sliced(spark, folder), build, name, in_slices=True, **options)
    delay = disorder(events(spark, folder))
    return replay(spark, source(spark, folder), build, name, watermark=delay, **options)


def newest_watermark(spark: SparkSession, folder: str) -> datetime | bool:
    """The time of a marker that moves a replay's watermark to the newest event.

    False if there is no event, and for slices, after which it is there.
    """
    newest, oldest = events(spark, folder).agg(F.max("ts"), F.min("ts")).first()
    if newest is None or in_slices(spark, folder):
        return False
    return newest + (newest - oldest)


def stream_freq_in_hop(spark: SparkSession, folder: str) -> DataFrame:
    return replayed(
        spark,
        folder,
        lambda s: windows.event_frequency(s, A, 3, "1 hour", "10 minutes"),
        "freq_in_hop",
        event_type=A,
    )


def stream_a_then_b_in_hop(spark: SparkSession, folder: str) -> DataFrame:
    return replayed(
        spark,
        folder,
        lambda s: windows.followed_within(s, A, B, "1 hour", "10 minutes"),
        "a_then_b_in_hop",
        event_type=A,
    )


def whole(events: DataFrame) -> DataFrame:
    return events


def stepped(spark: SparkSession, folder: str, step: stepwise.Step, carry: str, name: str, slim=whole) -> DataFrame:
    """All rows of a step over the stored events, slice by slice; ``slim`` makes of the events what the step needs."""
    return stepwise.rows_of(spark, step_run(spark, folder, step, carry, name, slim))


def step_run(spark: SparkSession, folder: str, step: stepwise.Step, carry: str, name: str, slim=whole) -> str:
    """The folder with what a step has written over the stored events."""
    run = work_dir(spark, name)
    run_to_end(stepwise.stepwise(slim(sliced(spark, folder)), step, carry, run, f"{run}/checkpoint"), in_slices=True)
    return run


def stream_overlap_join_ab(spark: SparkSession, folder: str) -> DataFrame:
    slim = lambda s: s.select("event_id", "ts", "event_type").where(F.col("event_type").isin(A, B))

    def build(stream: DataFrame, since: int | None = None) -> DataFrame:
        sides = (stream.where(F.col("event_type") == t) for t in (A, B))
        return overlap_join(*sides, "1 hour", "10 minutes", since=since).select(
            "left_event_id", "right_event_id", "left_ts", "right_ts", "valid_from", "valid_to"
        )

    if in_slices(spark, folder):
        step = stepwise.pair_step(build, duration("70 minutes"))
        return stepped(spark, folder, step, "event_id BIGINT, ts TIMESTAMP, event_type STRING", "overlap_join_ab", slim)
    return replayed(spark, folder, lambda s: build(slim(s)), "overlap_join_ab", close=False)


def stream_seq_abc_immediate(spark: SparkSession, folder: str) -> DataFrame:
    if in_slices(spark, folder):
        return stepped(spark, folder, *automata.match_step([A, B, C], "10 minutes"), "seq_abc_immediate")
    return replayed(
        spark,
        folder,
        lambda s: windowed.stream_match_sequence(s, [A, B, C], "10 minutes", bin_width="10 seconds"),
        "seq_abc_immediate",
    )


def stream_geofence_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return replayed(
        spark,
        folder,
        lambda s: keyed.stream_geofence_transitions(with_location(s), places.FENCE, bin_width="1 hour"),
        "geofence_transitions",
        props='{"k": 1}',
    )


def stream_threshold_cross_up(spark: SparkSession, folder: str) -> DataFrame:
    return replayed(
        spark,
        folder,
        lambda s: keyed.stream_threshold_cross_up(s, 42, bin_width="1 hour"),
        "threshold_cross_up",
    )


def stream_avg_last_n(spark: SparkSession, folder: str) -> DataFrame:
    """The last average of each device, where it is below the threshold."""
    updates = replayed(
        spark,
        folder,
        lambda s: keyed.stream_average_of_last(s, C, 10, bin_width="1 hour"),
        "avg_last_n",
        event_type=C,
        value=0.0,
    )
    final = updates.groupBy("user_id").agg(F.max_by("average", "as_of").alias("average"))
    return final.where(F.col("average") < 50)


def stream_messy_avg_last_n(spark: SparkSession, folder: str) -> DataFrame:
    """The same with values that are no samples."""
    updates = replayed(
        spark,
        folder,
        lambda s: keyed.stream_average_of_last(basics.messy(s, ties=False), C, 10, bin_width="1 hour"),
        "messy_avg_last_n",
        event_type=C,
        value=0.0,
    )
    final = updates.groupBy("user_id").agg(F.max_by("average", "as_of").alias("average"))
    return final.where(F.col("average") < 50)


def stream_device_liveness(spark: SparkSession, folder: str) -> DataFrame:
    """Silences as of the newest event: the marker moves the watermark just there."""
    return replayed(
        spark,
        folder,
        lambda s: windowed.stream_liveness(s, "18 hours", "24 hours"),
        "device_liveness",
        close=newest_watermark(spark, folder),
    )


def stream_inside_fence_hop(spark: SparkSession, folder: str) -> DataFrame:
    near = replayed(
        spark,
        folder,
        lambda s: windows.nearest_to_point(
            with_location(s), fence_distance(places.FENCE), "1 hour", "10 minutes", 20_000.0
        ),
        "inside_fence_hop",
    )
    return near.withColumn("distance", F.round("distance", 2))


def stream_seq_fsm_hop(spark: SparkSession, folder: str) -> DataFrame:
    if in_slices(spark, folder):
        step = automata.fsm_step((A, B, C, D), "1 hour", "10 minutes")
        return stepped(spark, folder, step, automata.FSM_CARRY, "seq_fsm_hop")
    return replayed(
        spark,
        folder,
        lambda s: windowed.stream_sequence_fsm(s, (A, B, C, D), "1 hour", "10 minutes"),
        "seq_fsm_hop",
        event_type=A,
    )


def stream_proximity_named(spark: SparkSession, folder: str) -> DataFrame:
    pairs = places.watched_pairs(spark, folder)
    build = lambda located: named_proximity(located, pairs, "1 day", "6 hours", 1.0)
    if in_slices(spark, folder):
        step, still_open = stepwise.window_step(with_location, build, duration("1 day"))
        layout = "event_id BIGINT, user_id BIGINT, ts TIMESTAMP, lat DOUBLE, lon DOUBLE"
        run = step_run(spark, folder, step, layout, "proximity_named")
        near = stepwise.rows_of(spark, run).unionByName(still_open(stepwise.carried(spark, run)))
    else:
        near = replayed(spark, folder, lambda s: build(with_location(s)), "proximity_named")
    return near.withColumn("distance", F.round("distance", 6))


def stream_proximity_box(spark: SparkSession, folder: str) -> DataFrame:
    def build(stream: DataFrame, since: int | None = None) -> DataFrame:
        return box_pairs(stream, 0.16, 0.165, "30 minutes", "1 minute", since=since)

    if in_slices(spark, folder):
        step = stepwise.pair_step(build, duration("31 minutes"))
        layout = "event_id BIGINT, user_id BIGINT, ts TIMESTAMP, lat DOUBLE, lon DOUBLE"
        slim = lambda s: with_location(s).select("event_id", "user_id", "ts", "lat", "lon")
        near = stepped(spark, folder, step, layout, "proximity_box", slim)
    else:
        near = replayed(spark, folder, lambda s: build(with_location(s)), "proximity_box", close=False)
    return near.withColumns({n: F.round(n, 6) for n in ("lat_diff", "lon_diff")})


def stream_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """A feed that brings a fifth of its events twice, each kept once."""

    def build(stream: DataFrame) -> DataFrame:
        twice = stream.unionByName(stream.where(F.col("event_id") % 5 == 0))
        return windowed.stream_distinct(twice, ["user_id", "event_type", "ts"]).select("user_id", "event_type", "ts")

    return replayed(spark, folder, build, "distinct", close=False)


def kept_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Each device's position as a table that the stream keeps up to date."""
    run = work_dir(spark, "latest_location")
    located = with_location(source(spark, folder))
    newest = F.max_by(F.struct("ts", "lat", "lon"), F.struct("ts", "event_id")).alias("newest")
    state = located.groupBy("user_id").agg(newest).select("user_id", "newest.*")
    run_to_end(sinks.kept_table(state, f"{run}/out", f"{run}/checkpoint", ["user_id"]))
    return changelog.current(spark, f"{run}/out", ["user_id"])


def stream_latest_location(spark: SparkSession, folder: str) -> DataFrame:
    rows = kept_positions(spark, folder)
    return rows.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


def stream_geo_report(spark: SparkSession, folder: str) -> DataFrame:
    """The position report from the kept positions alone, not from the history of events."""
    return reports.positions_report(kept_positions(spark, folder))


def stream_seq_last_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Devices whose types were last seen in pattern order, from a table of last times that a stream keeps."""
    run = work_dir(spark, "last_seen")
    state = last_seen(source(spark, folder), basics.ALL_TYPES)
    run_to_end(sinks.kept_table(state, f"{run}/out", f"{run}/checkpoint", ["user_id"]))
    kept = changelog.current(spark, f"{run}/out", ["user_id"])
    return in_pattern_order(kept, patterns.PATTERNS)


def stream_snapshot_count(spark: SparkSession, folder: str) -> DataFrame:
    return replayed(
        spark,
        folder,
        lambda s: windows.snapshot_count(s, A, "80 minutes", "10 minutes"),
        "snapshot_count",
        event_type=A,
    )


def stream_event_table(spark: SparkSession, folder: str) -> DataFrame:
    """Events appended to a table by type and day, read back."""
    run = work_dir(spark, "event_table")
    slim = source(spark, folder).select("event_id", "ts", "user_id", "event_type", "value")
    run_to_end(sinks.event_table(slim, f"{run}/out", f"{run}/checkpoint"))
    return spark.read.parquet(f"{run}/out").drop("event_date")


def stream_alert_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of two stateless rules, written under their topics and read back."""
    run = work_dir(spark, "alert_topics")
    stream = with_location(source(spark, folder))
    high = above(stream, "value", 10)
    near = stream.withColumn("distance", fence_distance(places.FENCE)).where(F.col("distance") <= 20_000.0)
    alerts = all_alerts(
        as_alert(high, "evaluation-events", "above", F.col("user_id"), "ts", "ts", F.col("value")),
        as_alert(near, "geo-events", "near", F.col("user_id"), "ts", "ts", F.round("distance", 2)),
    )
    run_to_end(sinks.topic_files(alerts, f"{run}/out", f"{run}/checkpoint"))
    return spark.read.parquet(f"{run}/out")


def kept_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What a stream keeps of each device for the event report's questions."""
    types = sorted({t for p in patterns.PATTERNS for t in p})
    asked = (basics.EVAL_RULES, [(A, B, "24 hours"), (A, A, "7 days")], types)
    if in_slices(spark, folder):
        run = step_run(spark, folder, devices.facts_step(*asked), devices.FACTS_CARRY, "facts")
        return devices.facts_of(stepwise.carried(spark, run))
    run = work_dir(spark, "facts")
    stream = source(spark, folder).withWatermark("ts", disorder(events(spark, folder)))
    updates = facts.device_facts(stream, *asked)
    writer = updates.writeStream.format("parquet").option("path", f"{run}/out")
    run_to_end(writer.option("checkpointLocation", f"{run}/checkpoint"))
    return facts.kept(spark, f"{run}/checkpoint")


def stream_rule_table(spark: SparkSession, folder: str) -> DataFrame:
    return facts.rules_now(kept_facts(spark, folder), basics.EVAL_RULES)


def stream_lookback_b_before_a(spark: SparkSession, folder: str) -> DataFrame:
    return facts.lookback_now(kept_facts(spark, folder), A, B, "24 hours")


def stream_freq_lookback(spark: SparkSession, folder: str) -> DataFrame:
    return facts.frequency_now(kept_facts(spark, folder), A, 3, "7 days")


def stream_event_report(spark: SparkSession, folder: str) -> DataFrame:
    """The event report from the stream's state, not from the history of events."""
    known = kept_facts(spark, folder)
    last = facts.last_seen_now(known, sorted({t for p in patterns.PATTERNS for t in p}))
    return reports.report_lines(
        facts.lookback_now(known, A, B, "24 hours"),
        facts.frequency_now(known, A, 3, "7 days"),
        in_pattern_order(last, patterns.PATTERNS),
        facts.rules_now(known, basics.EVAL_RULES),
    )


def stream_liveness_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The stages of silences as of the newest event: in files of any order, the marker moves the watermark just there."""
    if in_slices(spark, folder):
        return stepped(spark, folder, devices.silence_step(timing.TICK), devices.SILENCE_CARRY, "liveness_steps")
    return replayed(
        spark, folder, lambda s: keyed.stream_liveness_steps(s, timing.TICK), "liveness_steps", close=newest_watermark(spark, folder)
    )


_LIVENESS = f"SELECT user_id, last_seen, status, since FROM ({timing.QUERIES['device_liveness'].sql})"

QUERIES = {
    "stream_freq_in_hop": Query(stream_freq_in_hop, timing.QUERIES["freq_in_hop"].sql),
    "stream_a_then_b_in_hop": Query(stream_a_then_b_in_hop, timing.QUERIES["a_then_b_in_hop"].sql),
    "stream_overlap_join_ab": Query(stream_overlap_join_ab, timing.QUERIES["overlap_join_ab"].sql),
    "stream_seq_abc_immediate": Query(stream_seq_abc_immediate, patterns.QUERIES["seq_abc_immediate"].sql),
    "stream_geofence_transitions": Query(
        stream_geofence_transitions, places.QUERIES["geofence_transitions"].sql
    ),
    "stream_threshold_cross_up": Query(stream_threshold_cross_up, basics.QUERIES["threshold_cross_up"].sql),
    "stream_avg_last_n": Query(stream_avg_last_n, basics.QUERIES["avg_last_n"].sql),
    "stream_messy_avg_last_n": Query(
        stream_messy_avg_last_n,
        basics.QUERIES["messy_avg_last_n"].sql.replace("date_trunc('day', ts) AS ts", "ts"),
    ),
    "stream_device_liveness": Query(stream_device_liveness, _LIVENESS),
    "stream_inside_fence_hop": Query(stream_inside_fence_hop, places.QUERIES["inside_fence_hop"].sql),
    "stream_seq_fsm_hop": Query(stream_seq_fsm_hop, patterns.QUERIES["seq_fsm_hop"].sql),
    "stream_proximity_named": Query(stream_proximity_named, places.QUERIES["proximity_named"].sql),
    "stream_proximity_box": Query(stream_proximity_box, places.QUERIES["proximity_box"].sql),
    "stream_distinct": Query(stream_distinct, "SELECT DISTINCT user_id, event_type, ts FROM events"),
    "stream_latest_location": Query(stream_latest_location, places.QUERIES["latest_location"].sql),
    "stream_geo_report": Query(stream_geo_report, reports.QUERIES["geo_report"].sql),
    "stream_seq_last_seen": Query(stream_seq_last_seen, patterns.QUERIES["seq_last_seen"].sql),
    "stream_snapshot_count": Query(stream_snapshot_count, timing.QUERIES["snapshot_count"].sql),
    "stream_rule_table": Query(stream_rule_table, basics.QUERIES["rule_table"].sql),
    "stream_lookback_b_before_a": Query(stream_lookback_b_before_a, timing.QUERIES["lookback_b_before_a"].sql),
    "stream_freq_lookback": Query(stream_freq_lookback, timing.QUERIES["freq_lookback"].sql),
    "stream_event_report": Query(stream_event_report, reports.QUERIES["event_report"].sql),
    "stream_liveness_steps": Query(stream_liveness_steps, timing.QUERIES["liveness_steps"].sql),
    "stream_event_table": Query(
        stream_event_table, "SELECT event_id, ts, user_id, event_type, value FROM events"
    ),
    "stream_alert_topics": Query(
        stream_alert_topics,
        f"""WITH {places.LOCATIONS}
            SELECT 'evaluation-events' AS topic, 'above' AS rule, CAST(user_id AS VARCHAR) AS subject,
                   ts AS valid_from, ts AS valid_to, value AS measure FROM loc WHERE value > 10
            UNION ALL
            SELECT 'geo-events', 'near', CAST(user_id AS VARCHAR), ts, ts, round({places.TO_FENCE}, 2)
            FROM loc WHERE {places.TO_FENCE} <= 20000""",
    ),
}
