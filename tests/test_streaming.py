"""Streams: sinks, restarts, late events, and equality with batch on random input."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseline.operators import evaluation, sequences
from pulseline.operators.filters import retained
from pulseline.operators.geo import Fence, box_pairs, geofence_transitions
from pulseline.streaming import keyed, sinks, windowed
from pulseline.streaming.replay import replay, run_to_end

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, lat double, lon double"


def events(seed, n=300):
    rng = random.Random(seed)
    return [
        (
            i,
            T0 + timedelta(milliseconds=100 * rng.randrange(3000)),
            0 if rng.random() < 0.34 else rng.randrange(4),
            rng.choice("abcd"),
            float(rng.randrange(-20, 60)),
            rng.choice([0.0, 1.0]),
            0.0,
        )
        for i in range(n)
    ]


@pytest.fixture()
def feed(spark, tmp_path):
    """Events in four files, in time order, read one file per batch."""
    rows = sorted(events(1), key=lambda r: (r[1], r[0]))
    path = str(tmp_path / "feed")
    for part in range(4):
        cut = rows[part * 75 : (part + 1) * 75]
        spark.createDataFrame(cut, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stored, stream


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    left = sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=str)
    right = sorted(map(tuple, want.select(*sorted(want.columns)).collect()), key=str)
    assert left == right and left


def test_geofence(spark, feed):
    stored, stream = feed
    fence = Fence(0.0, 0.0, "1 km")
    got = replay(
        spark, stream, lambda s: keyed.stream_geofence_transitions(s, fence, bin_width="7 seconds"), "t", lat=5.0, lon=5.0
    )
    same(got, geofence_transitions(stored, fence))


def test_threshold(spark, feed):
    stored, stream = feed
    got = replay(spark, stream, lambda s: keyed.stream_threshold_cross_up(s, 30, bin_width="1 minute"), "t")
    same(got, evaluation.threshold_cross_up(stored, 30, ["user_id"]))


def test_average(spark, feed):
    stored, stream = feed
    got = replay(
        spark,
        stream,
        lambda s: keyed.stream_average_of_last(s, "a", 5, bin_width="10 seconds"),
        "t",
        event_type="a",
        value=0.0,
    )
    final = got.groupBy("user_id").agg(F.max_by("average", "as_of").alias("average"))
    same(final.where("average < 25"), evaluation.average_of_last(stored, "a", 5, 25))


@pytest.mark.parametrize("bin_width", ["1 second", "20 seconds"])
@pytest.mark.parametrize("by_user", [False, True])
def test_sequence(spark, feed, bin_width, by_user):
    stored, stream = feed
    keys = ("user_id",) if by_user else ()
    steps = ["a", ["b", "c"], "d"]
    got = replay(
        spark, stream, lambda s: windowed.stream_match_sequence(s, steps, "4 seconds", keys, bin_width), "t"
    )
    same(got, sequences.match_sequence(stored, steps, "4 seconds", keys))


def test_state_machine(spark, feed):
    stored, stream = feed
    steps = ("a", "b", "c", "d")
    got = replay(
        spark, stream, lambda s: windowed.stream_sequence_fsm(s, steps, "20 seconds", "5 seconds"), "t", event_type="a"
    )
    same(got, sequences.sequence_fsm(stored, steps, "20 seconds", "5 seconds"))


def test_box_pairs(spark, feed):
    stored, stream = feed

    def build(df):
        return box_pairs(df, 0.5, 0.5, "6 seconds", "2 seconds")

    same(replay(spark, stream, build, "t", close=False), build(stored))


def test_late_events_are_dropped(spark, tmp_path):
    path = str(tmp_path / "late")
    schema = "event_id long, ts timestamp, user_id long"
    # Spark holds events against the watermark of the batch before last.
    for number, second in enumerate([60, 62, 0, 90]):
        rows = [(number, T0 + timedelta(seconds=second), 1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)

    def run(watermark):
        stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path)
        build = lambda s: s.groupBy(F.window("ts", "10 seconds")).agg(F.count("*").alias("n"))
        return replay(spark, stream, build, "late", watermark=watermark, lossless=False).agg(F.sum("n")).first()[0]

    assert run("0 seconds") == 3
    assert run("2 minutes") == 4


def test_report_and_restart(spark, feed, tmp_path):
    stored, stream = feed
    table, path, state = (str(tmp_path / n) for n in ("table", "report", "state"))

    def make(df):
        return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))

    for _ in range(2):  # The second run finds nothing new.
        run_to_end(sinks.report(stream, table, path, make, state))
    assert spark.read.parquet(path).select("batch").distinct().count() == 4
    same(sinks.newest_report(spark, path), make(stored))


def test_updates(spark, feed, tmp_path):
    stored, stream = feed
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    newest = [F.count(F.lit(1)).alias("n"), F.max("ts").alias("seen")]
    run_to_end(sinks.updates(stream.groupBy("user_id").agg(*newest), path, state))
    same(sinks.newest_updates(spark, path, ["user_id"]), stored.groupBy("user_id").agg(*newest))


def test_fan_out(spark, feed, tmp_path):
    stored, stream = feed
    seen = {"a": 0, "b": 0}

    def count(kind):
        def action(batch, number):
            seen[kind] += batch.where(F.col("event_type") == kind).count()

        return action

    run_to_end(sinks.fan_out(stream, [count("a"), count("b")], str(tmp_path / "state")))
    assert seen == {k: stored.where(F.col("event_type") == k).count() for k in seen}


def test_event_table_layout(spark, feed, tmp_path):
    _, stream = feed
    path = tmp_path / "table"
    run_to_end(sinks.event_table(stream, str(path), str(tmp_path / "state")))
    assert {p.name for p in path.glob("event_type=*")} == {f"event_type={k}" for k in "abcd"}
    text = spark.read.parquet(str(path)).where("event_type = 'a'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_type" in text


def test_retention(spark, feed):
    stored, _ = feed
    kept = retained(stored, "60 seconds")
    top = stored.agg(F.max("ts")).first()[0]
    assert kept.count() == stored.where(F.col("ts") >= F.lit(top - timedelta(seconds=60))).count() > 0
