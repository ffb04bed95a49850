"""The merged log of a keyed table: right rows, few parts, one version at a time."""

import random

import pytest
from pyspark.sql import functions as F

from pulseline.streaming import changelog, sinks
from pulseline.streaming.replay import run_to_end


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v long, note string").coalesce(1)


def test_current_rows_after_many_batches(spark, tmp_path):
    rng, path, want = random.Random(3), str(tmp_path / "log"), {}
    for number in range(30):
        changed = {rng.randrange(12): (number, None if number % 3 else f"n{number}") for _ in range(3)}
        want |= changed
        changelog.add(frame(spark, [(k, *v) for k, v in changed.items()]), path, number, ["k"], fanout=3)
        live = changelog.parts(spark, path, number)
        # Fewer than three parts a level, and a level for each power of three.
        assert len(live) <= 2 * 4, live
    got = {r["k"]: (r["v"], r["note"]) for r in changelog.current(spark, path, ["k"]).collect()}
    assert got == want
    # Files of the last two versions only.
    assert changelog.versions(spark, path) == [28, 29]
    kept = {p.name for p in (tmp_path / "log" / "parts").iterdir()}
    assert kept == {name for v in (28, 29) for _, name in changelog.parts(spark, path, v)}
    before = {r["k"] for r in changelog.current(spark, path, ["k"], 28).collect()}
    assert before <= set(want)


def test_parts_grow_with_the_logarithm_of_batches():
    """The tier rule alone, for a thousand batches."""
    live, most = [], 0
    for _ in range(1_000):
        live.append(0)
        level = 0
        while live.count(level) >= 8:
            live = [x for x in live if x != level] + [level + 1]
            level += 1
        most = max(most, len(live))
    assert most <= 7 * 4


def test_a_batch_that_runs_again(spark, tmp_path):
    path = str(tmp_path / "log")
    changelog.add(frame(spark, [(1, 1, "a"), (2, 1, "a")]), path, 0, ["k"], fanout=2)
    changelog.add(frame(spark, [(1, 9, "failed")]), path, 1, ["k"], fanout=2)
    changelog.add(frame(spark, [(2, 2, "b")]), path, 1, ["k"], fanout=2)
    assert sorted(map(tuple, changelog.current(spark, path, ["k"]).collect())) == [(1, 1, "a"), (2, 2, "b")]


@pytest.mark.parametrize("fanout", [2, 8])
def test_a_stream_keeps_its_table(spark, tmp_path, fanout):
    rows = [(i, i % 5, i * 7 % 13) for i in range(60)]
    for part in range(6):
        spark.createDataFrame(rows[part::6], "i long, k long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = stream.groupBy("k").agg(F.max("v").alias("v"), F.count("*").alias("n"))
    for _ in range(2):
        run_to_end(sinks.kept_table(state, str(tmp_path / "log"), str(tmp_path / "state"), ["k"], fanout))
    got = sorted(map(tuple, changelog.current(spark, str(tmp_path / "log"), ["k"]).select("k", "v", "n").collect()))
    want = sorted(map(tuple, stored.groupBy("k").agg(F.max("v"), F.count("*")).collect()))
    assert got == want
