"""Replays of tables in several files, and sessions without a shared folder."""

import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from checks import database, rows_of
from pyspark.sql import functions as F

from pulseline.plans import streams
from pulseline.plans.catalogue import QUERIES
from pulseline.sources import slices
from pulseline.sources.tables import events
from pulseline.streaming.replay import LateRowsDropped, replay

ROOT = Path(__file__).resolve().parents[1]
STREAMS = sorted(q for q in QUERIES if q.startswith("stream_"))


@pytest.fixture(scope="module")
def parts(spark, folder, tmp_path_factory):
    """The tables with the events as a folder of part files, the newest events in the first."""
    path = tmp_path_factory.mktemp("parts")
    for table in Path(folder).glob("*.parquet"):
        if table.name != "events.parquet":
            (path / table.name).symlink_to(table)
    newest_first = spark.read.parquet(f"{folder}/events.parquet").orderBy("ts", ascending=False).coalesce(1)
    newest_first.write.option("maxRecordsPerFile", 120).parquet(str(path / "events.parquet"))
    assert len(list((path / "events.parquet").glob("part-*.parquet"))) >= 8
    return str(path)


@pytest.mark.parametrize("name", STREAMS)
def test_any_layout_gives_the_same_rows(spark, folder, parts, name, monkeypatch):
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 1)
    monkeypatch.setattr(slices, "SLICE_ROWS", 300)
    got = QUERIES[name](spark, parts).toPandas()
    assert rows_of(got) == rows_of(database(folder).execute(QUERIES[name].sql).df())


@pytest.mark.parametrize("name", ["stream_freq_in_hop", "stream_overlap_join_ab", "stream_device_liveness"])
def test_files_in_any_order_without_slices(spark, folder, parts, name, monkeypatch):
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 1)
    monkeypatch.setattr(slices, "readable", lambda uri, there=True: False)
    got = QUERIES[name](spark, parts).toPandas()
    assert rows_of(got) == rows_of(database(folder).execute(QUERIES[name].sql).df())


def test_losses_of_all_batches_count(spark, tmp_path):
    """Also those that a query has forgotten by its end."""
    t0 = datetime(2024, 1, 1)
    for number, second in enumerate([60, 62, 64, 0, *range(70, 80)]):
        row = [(number, t0 + timedelta(seconds=second), 1)]
        spark.createDataFrame(row, "event_id long, ts timestamp, user_id long").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "late")
        )
    stored = spark.read.parquet(str(tmp_path / "late"))
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    remembered = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(remembered, "5")
    try:
        with pytest.raises(LateRowsDropped, match="1 rows"):
            replay(spark, stream, lambda s: s.groupBy(F.window("ts", "10 seconds")).count(), "late")
    finally:
        spark.conf.unset(remembered)


def test_lost_rows_are_an_error(spark, parts, monkeypatch):
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 1)
    stream = streams.source(spark, parts)
    from pulseline.operators.windows import snapshot_count

    with pytest.raises(LateRowsDropped):
        replay(spark, stream, lambda s: snapshot_count(s, "view", "1 hour", "10 minutes"), "late")


def test_times_are_read(spark, parts, folder):
    assert events(spark, parts).count() == events(spark, folder).count()


PLAIN_SESSION = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pulseline.plans.catalogue import QUERIES
from pulseline.session import shared_root
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("set:", spark.conf.get("spark.checkpoint.dir", None))
print("rows:", QUERIES["stream_event_table"](spark, {folder!r}).count())
print("root:", shared_root(spark))
"""


def test_session_without_shared_folder(folder, tmp_path):
    """A plain local session with no configuration at all; its temporary folder goes with the process."""
    import os

    code = PLAIN_SESSION.format(root=str(ROOT), folder=folder)
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=300)
    assert "set: None" in done.stdout and "rows: 1000" in done.stdout, done.stderr[-2000:]
    assert not Path(done.stdout.split("root: ")[1].strip()).exists()
