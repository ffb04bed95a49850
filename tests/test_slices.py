"""The stream of time slices: plan, order, state, restart."""

import json
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pulseline.plans import streams
from pulseline.plans.catalogue import QUERIES
from pulseline.sources import slices

T0 = datetime(2024, 1, 1)


@pytest.fixture()
def feed(spark, tmp_path):
    """600 events in five files that overlap in time, one of them without statistics; some without a time."""
    rng = random.Random(4)
    rows = [(i, None if i % 97 == 0 else T0 + timedelta(seconds=rng.randrange(6_000))) for i in range(600)]
    (tmp_path / "feed").mkdir()
    for part in range(5):
        own = sorted(rows[part::5], key=lambda r: r[1] or T0)
        table = pa.table(
            {"event_id": [r[0] for r in own], "ts": pa.array([r[1] for r in own], pa.timestamp("us"))},
        )
        pq.write_table(table, tmp_path / "feed" / f"{part}.parquet", row_group_size=30, write_statistics=part != 3)
    return spark.read.parquet(str(tmp_path / "feed")), [r for r in rows]


def run(stream, path, batches):
    def keep(batch, number):
        batches.append(sorted((r["ts"] or datetime.min, r["event_id"]) for r in batch.collect()))

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", path).start()
    query.processAllAvailable()
    query.stop()


def test_slices_follow_each_other(spark, feed, tmp_path):
    stored, rows = feed
    stream = slices.slice_stream(spark, stored, str(tmp_path / "plan"), slice_rows=100)
    batches = []
    run(stream, str(tmp_path / "state"), batches)
    cuts = json.loads((tmp_path / "plan" / "slices.json").read_text())["cuts"]
    assert len(batches) == len(cuts) + 1 >= 5
    assert sorted(r for b in batches for r in b) == sorted((t or datetime.min, i) for i, t in rows)
    timed = [[t for t, _ in b if t != datetime.min] for b in batches]
    for earlier, later in zip(timed, timed[1:]):
        assert max(earlier) < min(later)
    assert all(len(b) < 250 for b in batches)
    # Rows without a time are in the first slice.
    assert sum(t == datetime.min for t, _ in batches[0]) == sum(t is None for _, t in rows)
    # Nothing is left after a restart.
    again = []
    run(slices.slice_stream(spark, stored, str(tmp_path / "plan")), str(tmp_path / "state"), again)
    assert again == [] or again == [[]]


def test_a_stopped_query_goes_on(spark, feed, tmp_path):
    stored, rows = feed
    batches = []

    def fails(batch, number):
        if number == 2:
            raise RuntimeError("stop here")
        batches.append([r["event_id"] for r in batch.collect()])

    stream = slices.slice_stream(spark, stored, str(tmp_path / "plan"), slice_rows=100)
    query = stream.writeStream.foreachBatch(fails).option("checkpointLocation", str(tmp_path / "state")).start()
    with pytest.raises(Exception):
        query.awaitTermination()
    rest = []
    run(slices.slice_stream(spark, stored, str(tmp_path / "plan")), str(tmp_path / "state"), rest)
    seen = [i for b in batches for i in b] + [i for b in rest for _, i in b]
    assert sorted(seen) == sorted(i for i, _ in rows)


def test_only_what_reaches_into_a_slice_is_read(spark, feed, tmp_path):
    stored, _ = feed
    slices.slice_stream(spark, stored, str(tmp_path / "plan"), slice_rows=100)
    reader = slices.TimeSliceReader(str(tmp_path / "plan"), str(tmp_path / "plan"), "ts", stored.schema)
    groups = [sum(len(p.groups) for p in reader.partitions({"slices": k}, {"slices": k + 1})) for k in range(5)]
    # 20 row groups in all; the file without statistics is always read.
    assert all(g < 20 for g in groups[1:]), groups
    assert reader.partitions({"slices": 3}, {"slices": 2}) == []


def test_state_holds_no_more_than_two_slices(spark, feed, tmp_path):
    stored, _ = feed
    stream = slices.slice_stream(spark, stored.where("ts is not null").where("event_id >= 0"), str(tmp_path / "plan"), slice_rows=100)
    timed = stream.where("ts is not null").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    distinct = timed.withWatermark("ts", "0 seconds").dropDuplicatesWithinWatermark(["event_id"])
    query = distinct.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = query.option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    dropped = sum(p.stateOperators[0].numRowsDroppedByWatermark for p in query.recentProgress)
    assert len(states) >= 5 and max(states) <= 250 and dropped == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == stored.where("ts is not null").count()


def test_empty_tables_and_unknown_stores(spark, tmp_path):
    spark.range(0).selectExpr("id as event_id", "cast(null as timestamp_ntz) as ts").write.parquet(str(tmp_path / "none"))
    stored = spark.read.parquet(str(tmp_path / "none"))
    batches = []
    run(slices.slice_stream(spark, stored, str(tmp_path / "plan")), str(tmp_path / "state"), batches)
    assert [r for b in batches for r in b] == []
    assert slices.readable(str(tmp_path)) and slices.readable(f"file://{tmp_path}")
    assert not slices.readable("viewfs://store/in") and not slices.readable(str(tmp_path / "missing"))


@pytest.mark.parametrize("name", ["overlap_join_ab", "proximity_box"])
def test_pairs_over_many_slices(spark, monkeypatch, name):
    """Pairs within a slice and across slices come up once each, and nothing goes through a state store."""
    folder = "/root/testdata/sf0.01"  # in the smallest tables no two devices meet
    monkeypatch.setattr(slices, "SLICE_ROWS", 3_000)
    monkeypatch.setattr(streams, "replayed", None)
    got = streams.QUERIES[f"stream_{name}"](spark, folder)
    want = QUERIES[name](spark, folder).select(*got.columns)
    assert want.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["proximity_named", "lookback_b_before_a", "liveness_steps"])
def test_answers_over_many_slices(spark, folder, monkeypatch, name):
    """What is open or kept goes on from slice to slice, and no device is asked through a state store."""
    monkeypatch.setattr(slices, "SLICE_ROWS", 300)
    monkeypatch.setattr(streams, "replayed", None)
    monkeypatch.setattr(streams.facts, "device_facts", None)
    got = streams.QUERIES[f"stream_{name}"](spark, folder)
    want = QUERIES[name](spark, folder).select(*got.columns)
    assert want.count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
