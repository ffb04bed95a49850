"""A keyed table that a stream keeps up to date, as a log that is merged while it grows.

Each micro-batch adds a part with the rows it changed. Parts are merged by size tiers: as soon as ``fanout`` parts
of one level are there, they become one part of the next, with the newest row per key. So a row is
written again about log(batches) times, and a reader opens at most ``fanout`` parts a level.

A version is a small file that lists the live parts of a batch; it appears at once, and readers take the newest. The
parts of the last two versions stay, so whoever reads the one before is not disturbed. A batch that runs again after
a failure starts from the version before it and replaces what it wrote.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQ = "_seq"


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    store, where = _store(spark, path)
    return [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in names(spark, f"{path}/versions") if n.isdigit())


def parts(spark: SparkSession, path: str, version: int) -> list[tuple[int, str]]:
    """(level, name) of the live parts of a version."""
    return [tuple(p) for p in json.loads(spark.read.text(f"{path}/versions/{version}", wholetext=True).first()[0])]


def _publish(spark: SparkSession, path: str, version: int, live: list[tuple[int, str]]) -> None:
    store, made = _store(spark, f"{path}/versions/.{version}.new")
    out = store.create(made, True)
    out.writeBytes(json.dumps(live))
    out.close()
    _, final = _store(spark, f"{path}/versions/{version}")
    store.delete(final, False)
    if not store.rename(made, final):
        raise OSError(f"cannot publish version {version} of {path}")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), SEQ).alias("_newest")).select(*keys, "_newest.*")


def _read(spark: SparkSession, path: str, live: list[tuple[int, str]]) -> DataFrame:
    schema = spark.read.parquet(f"{path}/parts/{live[-1][1]}").schema
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{path}/parts/{name}") for _, name in live])


def add(changes: DataFrame, path: str, number: int, keys: list[str], fanout: int = 8) -> None:
    """Make version ``number`` of the table: the one before with ``changes``, at most one row per key."""
    spark = changes.sparkSession
    live = parts(spark, path, number - 1) if number else []
    name = f"{number}-0"
    changes.withColumn(SEQ, F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/parts/{name}")
    live.append((0, name))
    level = 0
    while sum(at == level for at, _ in live) >= fanout:
        own = [p for p in live if p[0] == level]
        name = f"{number}-{level + 1}"
        _newest(_read(spark, path, own), keys).write.mode("overwrite").parquet(f"{path}/parts/{name}")
        live = [p for p in live if p[0] != level] + [(level + 1, name)]
        level += 1
    _publish(spark, path, number, live)
    before = parts(spark, path, number - 1) if number else []
    wanted = {name for _, name in [*live, *before]}
    for folder, keep in (("parts", wanted), ("versions", {str(number), str(number - 1)})):
        for old in names(spark, f"{path}/{folder}"):
            if old not in keep:
                store, where = _store(spark, f"{path}/{folder}/{old}")
                store.delete(where, True)


def current(spark: SparkSession, path: str, keys: list[str], version: int | None = None) -> DataFrame:
    """The table as of a version, by default the newest."""
    version = versions(spark, path)[-1] if version is None else version
    return _newest(_read(spark, path, parts(spark, path, version)), keys).drop(SEQ)
