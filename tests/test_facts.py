"""Standing questions from a stream's state: equal to the batch rules, bounded, and touched only where events come."""

import random
from datetime import datetime, timedelta

import pytest

from pulseline.operators import evaluation, filters, joins, liveness
from pulseline.operators.skew import Budget
from pulseline.sources import slices
from pulseline.sources.rules import EvalRule
from pulseline.streaming import devices, facts, keyed, stepwise
from pulseline.streaming.replay import replay, run_to_end

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
RULES = [EvalRule("a", ">", 3, 10), EvalRule("b", "avg<", 4, 5), EvalRule("a", "avg<", 2, 0)]
WATCHED = [("a", "b", "50 seconds"), ("c", "c", "2 minutes")]


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    rng = random.Random(21)
    path = str(tmp_path_factory.mktemp("facts") / "feed")
    rows = []
    for i in range(800):
        t = T0 + timedelta(milliseconds=rng.randrange(1_200_000))
        user = 0 if rng.random() < 0.4 else rng.randrange(1, 12)
        value = rng.choice([None, 1e30, -3.7, float(rng.randrange(-20, 40))])
        rows.append((i, t, user, rng.choice("abcd"), value))
    spark.createDataFrame(rows, SCHEMA).repartition(3).sortWithinPartitions("ts").write.option("parquet.block.size", 2048).parquet(path)
    return spark.read.parquet(path)


def run(spark, stored, tmp_path, rows):
    stream = slices.slice_stream(spark, stored, str(tmp_path / "plan"), slice_rows=rows)
    stream = stream.withColumn("ts", stream["ts"].cast("timestamp")).withWatermark("ts", "0 seconds")
    updates = facts.device_facts(stream, RULES, WATCHED, list("abcd"))
    query = updates.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = query.option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    return facts.kept(spark, str(tmp_path / "state")), query.recentProgress


def same(got, want):
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    left, right = (sorted(map(tuple, df.select(names).collect()), key=str) for df in (got, want))
    assert left == right and left


@pytest.mark.parametrize("rows", [150, 10_000])
def test_answers_are_those_of_the_batch(spark, feed, tmp_path, rows):
    known, progress = run(spark, feed, tmp_path, rows)
    stored = feed.withColumn("ts", feed["ts"].cast("timestamp"))
    same(facts.rules_now(known, RULES), evaluation.evaluate_rules(stored, RULES))
    hits = joins.lookback(stored, "a", "b", "50 seconds").select("user_id", "event_id", "ts", "anchor_ts")
    same(facts.lookback_now(known, "a", "b", "50 seconds"), hits)
    same(facts.frequency_now(known, "c", 2, "2 minutes"), joins.frequency_lookback(stored, "c", 2, "2 minutes"))
    same(facts.last_seen_now(known, list("abcd")), filters.last_seen(stored, list("abcd")))
    if rows == 150:
        # A batch touches a device once, however much it has had before.
        updated = [(p.numInputRows, p.stateOperators[0].numRowsUpdated) for p in progress if p.numInputRows]
        assert len(updated) >= 5 and all(0 < u <= 12 < n for n, u in updated)
        # What is kept of the busiest device is bounded by the rules and the lookback, not by its 300 events.
        for r in known.collect():
            assert len(r["newest"]) <= 3 + 4
            last = dict(r["last"])
            for e in r["recent"]:
                assert e["event_type"] in "bc"
            assert sum(e["event_type"] == "b" for e in r["recent"]) < 60 and "a" in last


def test_files_in_any_order_under_a_watermark(spark, feed, tmp_path):
    stored = feed.withColumn("ts", feed["ts"].cast("timestamp"))
    path = str(tmp_path / "newest-first")
    stored.orderBy("ts", ascending=False).coalesce(1).write.option("maxRecordsPerFile", 200).parquet(path)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "1 hour")
    updates = facts.device_facts(stream, RULES, WATCHED, ["a"])
    writer = updates.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    run_to_end(writer.option("checkpointLocation", str(tmp_path / "state")))
    known = facts.kept(spark, str(tmp_path / "state"))
    same(facts.rules_now(known, RULES), evaluation.evaluate_rules(stored, RULES))
    hits = joins.lookback(stored, "a", "b", "50 seconds").select("user_id", "event_id", "ts", "anchor_ts")
    same(facts.lookback_now(known, "a", "b", "50 seconds"), hits)


def test_silences_are_counted_by_timers(spark, tmp_path):
    """Ticks 60, 120, 180, 181, 242 and 243; any event starts anew, in one micro-batch or across several."""
    beats = {1: [0, 59, 200, 900], 2: [0, 60, 121], 3: [0, 243, 244], 4: [0, 500, 620], 5: [899]}
    rows = [(100 * d + k, T0 + timedelta(seconds=s), d, "a", 0.0) for d, times in beats.items() for k, s in enumerate(times)]
    path = str(tmp_path / "beats")
    spark.createDataFrame(rows, SCHEMA).repartition(2).sortWithinPartitions("ts").write.parquet(path)
    feed = spark.read.parquet(path)
    stored = feed.withColumn("ts", feed["ts"].cast("timestamp"))
    want = liveness.liveness_steps(stored)
    stages = sorted((r["user_id"], r["last_seen"].second + 60 * r["last_seen"].minute, r["status"], r["lost_time"]) for r in want.collect())
    assert stages[:4] == [(1, 59, "FULL", 1), (1, 59, "FULL", 2), (1, 200, "DISCONNECT", 0), (1, 200, "FAIL", 4)]
    assert [s for s in stages if s[0] == 2][:2] == [(2, 0, "FULL", 1), (2, 60, "FULL", 1)]
    for n, size in enumerate((4, 100)):
        stream = slices.slice_stream(spark, feed, str(tmp_path / f"plan{n}"), slice_rows=size)
        stream = stream.withColumn("ts", stream["ts"].cast("timestamp"))
        got = replay(spark, stream, keyed.stream_liveness_steps, "t", close=False, in_slices=True)
        same(got, want)


def stepped(spark, stored, tmp_path, step, carry, rows):
    stream = slices.slice_stream(spark, stored, str(tmp_path / "plan"), slice_rows=rows)
    stream = stream.withColumn("ts", stream["ts"].cast("timestamp"))
    run_to_end(stepwise.stepwise(stream, step, carry, str(tmp_path / "run"), str(tmp_path / "state")), in_slices=True)
    return str(tmp_path / "run")


@pytest.mark.parametrize("rows", [150, 10_000])
def test_carried_facts_answer_like_the_batch(spark, feed, tmp_path, rows):
    path = stepped(spark, feed, tmp_path, devices.facts_step(RULES, WATCHED, list("abcd")), devices.FACTS_CARRY, rows)
    carry = stepwise.carried(spark, path)
    # At most a device's last times, newest samples and the events within reach, not its history.
    assert carry.where("role = 'recent'").count() < feed.where("event_type in ('b', 'c')").count() / 2
    known, stored = devices.facts_of(carry), feed.withColumn("ts", feed["ts"].cast("timestamp"))
    same(facts.rules_now(known, RULES), evaluation.evaluate_rules(stored, RULES))
    hits = joins.lookback(stored, "a", "b", "50 seconds").select("user_id", "event_id", "ts", "anchor_ts")
    same(facts.lookback_now(known, "a", "b", "50 seconds"), hits)
    same(facts.frequency_now(known, "c", 2, "2 minutes"), joins.frequency_lookback(stored, "c", 2, "2 minutes"))
    same(facts.last_seen_now(known, list("abcd")), filters.last_seen(stored, list("abcd")))


@pytest.mark.parametrize(("rows", "hot"), [(150, False), (10_000, False), (300, True)])
def test_silences_by_slices_are_those_of_the_batch(spark, feed, tmp_path, rows, hot):
    step = devices.silence_step("100 milliseconds", *([Budget(rows=20, slice="10 seconds")] if hot else []))
    path = stepped(spark, feed, tmp_path, step, devices.SILENCE_CARRY, rows)
    stored = feed.withColumn("ts", feed["ts"].cast("timestamp"))
    same(stepwise.rows_of(spark, path), liveness.liveness_steps(stored, "100 milliseconds"))
    assert stepwise.carried(spark, path).count() == feed.select("user_id").distinct().count()
