"""What a registered query is made of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pulseline.functions.temporal import plain_times


@dataclass(frozen=True)
class Query:
    """A query over a table folder, and the SQL that must give the same rows (if there is one)."""

    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return plain_times(self.build(spark, folder))


# Names of the event types that stand for A to E.
A, B, C, D, E = "view", "click", "purchase", "signup", "error"
LETTERS = {A: "A", B: "B", C: "C", D: "D", E: "E"}

# Position of every event, as the SQL side derives it.
LOCATIONS = """loc AS (
  SELECT event_id, user_id, event_type, ts, value,
         39e0 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 3e-2 AS lat,
         -107e0 + ((event_id * 37) % 170) * 1e-2 AS lon
  FROM events)"""

NEWEST_LOCATION = """newest AS (
  SELECT user_id, max(ts) AS ts, arg_max(lat, ts) AS lat, arg_max(lon, ts) AS lon
  FROM loc GROUP BY user_id)"""


def hops(source: str, slide_minutes: int, per_event: int) -> str:
    """SQL for the windows of each row of ``source``: one row per window start ``ws``."""
    slide = f"INTERVAL '{slide_minutes} minutes'"
    return (
        f"(SELECT s.*, time_bucket({slide}, s.ts) - i * {slide} AS ws "
        f"FROM {source} s, (SELECT unnest(generate_series(0, {per_event - 1})) AS i))"
    )


def distance_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6372797.560856 * asin(sqrt(pow(sin(radians({lat1} - {lat2}) / 2), 2) "
        f"+ cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon1} - {lon2}) / 2), 2)))"
    )
