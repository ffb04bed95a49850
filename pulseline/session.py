"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings the operators rely on for right results: times are compared in UTC, and keyed
# streaming state needs a store with column families.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}

# Runtime re-planning. Split skewed join partitions even when the split needs an extra shuffle.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Join by hash instead of sorting once the real partitions turn out small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Save the changes of streaming state per batch, not a copy of all of it.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Merge the sessions of a hot device inside each map task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created; its own tuning stays."""
    given = spark.conf.getAll
    for key, value in {**{k: v for k, v in TUNING.items() if k not in given}, **REQUIRED}.items():
        if given.get(key) != value:
            spark.conf.set(key, value)
    return spark


def joined_in_place(spark: SparkSession) -> None:
    """Let a join use sides that were both dealt by some of its keys as they are, unless the session says otherwise."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    if key not in spark.conf.getAll:
        spark.conf.set(key, "false")


def local_session(
    name: str = "pulseline", cores: int | str = 8, memory: str = "8g", partitions: int | None = None
) -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**REQUIRED, **TUNING}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_ROOTS: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Only a local-mode session may run without that setting. It gets one temporary folder per
    process, which is removed when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _LOCAL_ROOTS:
        _LOCAL_ROOTS.append(tempfile.mkdtemp(prefix="pulseline-"))
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[0], ignore_errors=True)
    return _LOCAL_ROOTS[0]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``shared_root``. Its owner keeps it as long as results read from it."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
