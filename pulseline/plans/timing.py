"""Windows, lifetimes, time joins, liveness and arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.functions import temporal
from pulseline.operators import joins, liveness, windows
from pulseline.operators.evaluation import newest
from pulseline.operators.skew import Budget
from pulseline.plans.registry import A, B, Query, hops
from pulseline.sources.tables import events

# The test events are minutes apart, so a tick of silence is longer than a second.
TICK = "6 minutes"


def freq_in_hop(spark: SparkSession, folder: str) -> DataFrame:
    return windows.event_frequency(events(spark, folder), "VIEW", 3, "1 hour", "10 minutes")


def freq_in_hop_per_user(spark: SparkSession, folder: str) -> DataFrame:
    return windows.event_frequency(
        events(spark, folder), A, 2, "1 day", "6 hours", partition_by=("user_id",)
    )


def snapshot_count(spark: SparkSession, folder: str) -> DataFrame:
    return windows.snapshot_count(events(spark, folder), A, "80 minutes", "10 minutes")


def a_then_b_in_hop(spark: SparkSession, folder: str) -> DataFrame:
    return windows.followed_within(events(spark, folder), A, B, "1 hour", "10 minutes")


def a_then_b_per_user(spark: SparkSession, folder: str) -> DataFrame:
    return windows.followed_within(
        events(spark, folder), A, B, "1 day", "6 hours", partition_by=("user_id",)
    )


def point_lifetimes(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.point_lifetime(events(spark, folder)).select("event_id", "valid_from", "valid_to")


def hop_lifetimes(spark: SparkSession, folder: str) -> DataFrame:
    alive = temporal.hop_lifetime(events(spark, folder), "80 minutes", "10 minutes")
    return alive.select("event_id", "valid_from", "valid_to")


def shifted_lifetimes(spark: SparkSession, folder: str) -> DataFrame:
    alive = temporal.interval_lifetime(events(spark, folder), "1 second")
    return temporal.shift_lifetime(alive, "1 second", "1 second").select("event_id", "valid_from", "valid_to")


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    # Times lose their zone here, once per event, not in the result, once per pair.
    df = events(spark, folder).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")
    return df.where(F.col("event_type") == A), df.where(F.col("event_type") == B)


def overlap_join_ab(spark: SparkSession, folder: str) -> DataFrame:
    return joins.overlap_join(*_sides(spark, folder), "1 hour", "10 minutes").select(
        "left_event_id", "right_event_id", "left_ts", "right_ts", "valid_from", "valid_to"
    )


def overlap_join_tiled(spark: SparkSession, folder: str) -> DataFrame:
    """The same with buckets cut into tiles of few pairs."""
    return joins.overlap_join(*_sides(spark, folder), "1 hour", "10 minutes", budget=Budget(pairs=20)).select(
        "left_event_id", "right_event_id", "left_ts", "right_ts", "valid_from", "valid_to"
    )


def freq_in_hop_uneven(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 100 minutes every 45 minutes, per user: the size is no multiple of the slide."""
    return windows.event_frequency(events(spark, folder), A, 2, "100 minutes", "45 minutes", partition_by=("user_id",))


def overlap_join_ordered(spark: SparkSession, folder: str) -> DataFrame:
    pairs = joins.overlap_join(
        *_sides(spark, folder), "1 day", "1 hour", on=("user_id",), ordered=True
    )
    return pairs.select("user_id", "left_event_id", "right_event_id", "left_ts", "right_ts")


def lookback_b_before_a(spark: SparkSession, folder: str) -> DataFrame:
    hits = joins.lookback(events(spark, folder), A, B, "24 hours")
    return hits.select("user_id", "event_id", "ts", "anchor_ts")


def lookback_b_after_a(spark: SparkSession, folder: str) -> DataFrame:
    hits = joins.lookback(events(spark, folder), A, B, "24 hours", direction="after")
    return hits.select("user_id", "event_id", "ts", "anchor_ts")


def freq_lookback(spark: SparkSession, folder: str) -> DataFrame:
    return joins.frequency_lookback(events(spark, folder), A, 3, "7 days")


def newest_per_series(spark: SparkSession, folder: str) -> DataFrame:
    top = newest(events(spark, folder), 10, ["user_id", "event_type"])
    return top.select("user_id", "event_type", "event_id", "rank")


def threshold_cross_up_regular(spark: SparkSession, folder: str) -> DataFrame:
    hourly = (
        events(spark, folder)
        .groupBy(temporal.bin_of(F.col("ts"), temporal.duration("1 hour")).alias("hour"))
        .agg(F.max("value").alias("value"))
    )
    return joins.previous_tick(hourly, "hour", 100)


def device_liveness(spark: SparkSession, folder: str) -> DataFrame:
    return liveness.device_liveness(events(spark, folder), "18 hours", "24 hours")


def liveness_steps(spark: SparkSession, folder: str) -> DataFrame:
    return liveness.liveness_steps(events(spark, folder), TICK)


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth event arrives three places late."""
    late = F.when(F.col("event_id") % 5 == 0, 3).otherwise(0)
    return events(spark, folder).withColumn("arrival", F.col("event_id") + late)


def late_drop(spark: SparkSession, folder: str) -> DataFrame:
    return liveness.drop_late(_arrivals(spark, folder), "arrival").select("event_id", "arrival", "ts")


def late_flags(spark: SparkSession, folder: str) -> DataFrame:
    return liveness.flag_late(_arrivals(spark, folder), "arrival").select("event_id", "late")


def messy_late_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Arrival numbers with wide gaps, some missing, and a tenth of all the same; ranges of few rows."""
    number = F.col("event_id")
    arrival = (
        F.when(number % 7 == 0, None)
        .when(number % 10 == 0, F.lit(5_000_000_000))
        .otherwise((number + F.when(number % 5 == 0, 3).otherwise(0)) * 1_000_003)
    )
    rows = events(spark, folder).withColumn("arrival", arrival)
    return liveness.flag_late(rows, "arrival", budget=Budget(rows=500)).select("event_id", "late")


def order_check(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the order of their ids; the job fails if one is out of order in time."""
    return liveness.require_order(events(spark, folder), "event_id").select("event_id", "ts")


_AB_WINDOWS = f"""SELECT {{keys}}ws AS window_start, ws + INTERVAL '{{size}}' AS window_end,
         min(ts) FILTER (event_type = 'view') AS first_ts, max(ts) FILTER (event_type = 'click') AS last_ts
  FROM {{hops}} WHERE event_type IN ('view', 'click') GROUP BY ALL
  HAVING min(ts) FILTER (event_type = 'view') < max(ts) FILTER (event_type = 'click')"""

_LOOKBACK = """SELECT e.user_id, e.event_id, e.ts, a.anchor_ts
  FROM events e JOIN (SELECT user_id, max(ts) AS anchor_ts FROM events WHERE event_type = 'view' GROUP BY 1) a
    ON a.user_id = e.user_id
  WHERE e.event_type = 'click' AND e.ts BETWEEN {low} AND {high}"""

_LATE = """SELECT e.event_id, arrival, ts, coalesce(ts < max(ts) OVER (
    ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late
  FROM (SELECT *, event_id + CASE WHEN event_id % 5 = 0 THEN 3 ELSE 0 END AS arrival FROM events) e"""

_MESSY_LATE = """SELECT event_id, arrival IS NOT NULL AND coalesce(ts < max(ts) OVER (
    PARTITION BY arrival IS NULL ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late
  FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 5000000000
          ELSE (event_id + CASE WHEN event_id % 5 = 0 THEN 3 ELSE 0 END) * 1000003 END AS arrival FROM events)"""

QUERIES = {
    "freq_in_hop": Query(
        freq_in_hop,
        f"""SELECT event_type, ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, count(*) AS n
            FROM {hops("events", 10, 6)} WHERE event_type = 'view' GROUP BY ALL HAVING count(*) >= 3""",
    ),
    "freq_in_hop_per_user": Query(
        freq_in_hop_per_user,
        f"""SELECT event_type, user_id, ws AS window_start, ws + INTERVAL 1 DAY AS window_end, count(*) AS n
            FROM {hops("events", 360, 4)} WHERE event_type = 'view' GROUP BY ALL HAVING count(*) >= 2""",
    ),
    "snapshot_count": Query(
        snapshot_count,
        f"""SELECT ws + INTERVAL 70 MINUTE AS valid_from, ws + INTERVAL 80 MINUTE AS valid_to, count(*) AS n
            FROM {hops("events", 10, 8)} WHERE event_type = 'view' GROUP BY ws""",
    ),
    "a_then_b_in_hop": Query(
        a_then_b_in_hop, _AB_WINDOWS.format(keys="", size="1 hour", hops=hops("events", 10, 6))
    ),
    "a_then_b_per_user": Query(
        a_then_b_per_user,
        _AB_WINDOWS.format(keys="user_id, ", size="1 day", hops=hops("events", 360, 4)),
    ),
    "point_lifetimes": Query(
        point_lifetimes,
        "SELECT event_id, ts AS valid_from, ts + INTERVAL 1 MICROSECOND AS valid_to FROM events",
    ),
    "hop_lifetimes": Query(
        hop_lifetimes,
        """SELECT event_id, time_bucket(INTERVAL '10 minutes', ts) AS valid_from,
                  time_bucket(INTERVAL '10 minutes', ts) + INTERVAL 80 MINUTE AS valid_to FROM events""",
    ),
    "shifted_lifetimes": Query(
        shifted_lifetimes,
        """SELECT event_id, ts + INTERVAL 1 SECOND AS valid_from, ts + INTERVAL 2 SECOND AS valid_to
           FROM events""",
    ),
    "overlap_join_ab": Query(
        overlap_join_ab,
        """WITH h AS (SELECT *, time_bucket(INTERVAL '10 minutes', ts) AS s FROM events)
           SELECT a.event_id AS left_event_id, b.event_id AS right_event_id, a.ts AS left_ts, b.ts AS right_ts,
                  greatest(a.s, b.s) AS valid_from, least(a.s, b.s) + INTERVAL 1 HOUR AS valid_to
           FROM h a JOIN h b ON a.s < b.s + INTERVAL 1 HOUR AND b.s < a.s + INTERVAL 1 HOUR
           WHERE a.event_type = 'view' AND b.event_type = 'click'""",
    ),
    "freq_in_hop_uneven": Query(
        freq_in_hop_uneven,
        """SELECT event_type, user_id, ws AS window_start, ws + INTERVAL 100 MINUTE AS window_end, count(*) AS n
           FROM (SELECT e.*, time_bucket(INTERVAL '45 minutes', ts, TIMESTAMP '1970-01-01') - i * INTERVAL 45 MINUTE AS ws
                 FROM events e, (SELECT unnest([0, 1, 2]) AS i))
           WHERE event_type = 'view' AND ts < ws + INTERVAL 100 MINUTE GROUP BY ALL HAVING count(*) >= 2""",
    ),
    "overlap_join_ordered": Query(
        overlap_join_ordered,
        """WITH h AS (SELECT *, date_trunc('hour', ts) AS s FROM events)
           SELECT a.user_id, a.event_id AS left_event_id, b.event_id AS right_event_id,
                  a.ts AS left_ts, b.ts AS right_ts
           FROM h a JOIN h b ON a.user_id = b.user_id
           WHERE a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts
             AND a.s < b.s + INTERVAL 1 DAY AND b.s < a.s + INTERVAL 1 DAY""",
    ),
    "lookback_b_before_a": Query(
        lookback_b_before_a, _LOOKBACK.format(low="a.anchor_ts - INTERVAL 24 HOUR", high="a.anchor_ts")
    ),
    "lookback_b_after_a": Query(
        lookback_b_after_a, _LOOKBACK.format(low="a.anchor_ts", high="a.anchor_ts + INTERVAL 24 HOUR")
    ),
    "freq_lookback": Query(
        freq_lookback,
        """SELECT user_id, anchor_ts, count(*) AS n
           FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS anchor_ts FROM events WHERE event_type = 'view')
           WHERE ts >= anchor_ts - INTERVAL 7 DAY GROUP BY ALL HAVING count(*) >= 3""",
    ),
    "newest_per_series": Query(
        newest_per_series,
        """SELECT user_id, event_type, event_id, CAST(row_number() OVER w AS INT) AS rank FROM events
           WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)
           QUALIFY row_number() OVER w <= 10""",
    ),
    "threshold_cross_up_regular": Query(
        threshold_cross_up_regular,
        """WITH h AS (SELECT epoch_us(ts) // 3600000000 AS hour, max(value) AS value FROM events GROUP BY 1)
           SELECT c.hour, p.value AS low, c.value AS high
           FROM h c JOIN h p ON c.hour = p.hour + 1 WHERE c.value > 100 AND p.value < 100""",
    ),
    "device_liveness": Query(
        device_liveness,
        """WITH s AS (
             SELECT user_id, ts AS last_seen, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_seen,
                    max(ts) OVER () AS top FROM events)
           SELECT user_id, last_seen, next_seen, status, last_seen + h * INTERVAL 1 HOUR AS since
           FROM s, (VALUES ('OVER', 18), ('FAIL', 24)) AS v(status, h)
           WHERE coalesce(next_seen, top) - last_seen >= h * INTERVAL 1 HOUR""",
    ),
    "liveness_steps": Query(
        liveness_steps,
        """WITH s AS (
             SELECT user_id, ts AS last_seen, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_seen,
                    max(ts) OVER () AS top FROM events)
           SELECT user_id, last_seen, last_seen + n * INTERVAL 6 MINUTE AS since, status, CAST(lost AS INT) AS lost_time
           FROM s, (VALUES (60, 'FULL', 1), (120, 'FULL', 2), (180, 'FULL', 3), (181, 'OVER', 4), (242, 'FAIL', 4),
                           (243, 'DISCONNECT', 0)) AS v(n, status, lost)
           WHERE coalesce(next_seen, top) - last_seen >= n * INTERVAL 6 MINUTE""",
    ),
    "messy_late_flags": Query(messy_late_flags, _MESSY_LATE),
    "late_drop": Query(late_drop, f"SELECT event_id, arrival, ts FROM ({_LATE}) WHERE NOT late"),
    "order_check": Query(order_check, "SELECT event_id, ts FROM events"),
    "late_flags": Query(late_flags, f"SELECT event_id, late FROM ({_LATE})"),
}
QUERIES["overlap_join_tiled"] = Query(overlap_join_tiled, QUERIES["overlap_join_ab"].sql)
