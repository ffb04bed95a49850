"""Position queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.functions.text import alert_line
from pulseline.operators import geo, windows
from pulseline.operators.skew import Budget
from pulseline.plans.registry import LOCATIONS, NEWEST_LOCATION, Query, distance_sql, hops
from pulseline.sources.rules import Fence
from pulseline.sources.tables import events, with_location

# Centre of the detection area (fixed values).
LATITUDE, LONGITUDE = 40.00699, -105.26284
FENCE = Fence(LATITUDE, LONGITUDE, "100 km")


def located(spark: SparkSession, folder: str) -> DataFrame:
    return with_location(events(spark, folder))


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def latest_location(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(geo.latest_location(located(spark, folder)), 6, "lat", "lon")


def fence_membership(spark: SparkSession, folder: str) -> DataFrame:
    return geo.inside(located(spark, folder), FENCE).select("event_id", "user_id", "inside")


def geofence_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return geo.geofence_transitions(located(spark, folder), FENCE)


def geofence_transitions_hot(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a budget so small that every device counts as hot and is cut."""
    return geo.geofence_transitions(located(spark, folder), FENCE, budget=Budget(rows=20, slice="6 hours"))


def geofence_lines(spark: SparkSession, folder: str) -> DataFrame:
    moves = geo.geofence_transitions(located(spark, folder), FENCE)
    verb = F.when(F.col("transition") == "enter", "entering").otherwise("leaving")
    return moves.select("event_id", alert_line("Device %d is %s the geofence", F.col("user_id"), verb).alias("line"))


def inside_fence_hop(spark: SparkSession, folder: str) -> DataFrame:
    near = windows.nearest_to_point(
        located(spark, folder), geo.fence_distance(FENCE), "1 hour", "10 minutes", 20_000.0
    )
    return _rounded(near, 2, "distance")


def count_in_radius(spark: SparkSession, folder: str) -> DataFrame:
    return geo.count_within(geo.latest_location(located(spark, folder)), FENCE)


def near_point(positions: DataFrame) -> DataFrame:
    near = geo.within_radius(positions, FENCE)
    return _rounded(near, 2, "distance_m").select("user_id", "distance_m")


def near_pairs(positions: DataFrame) -> DataFrame:
    return geo.pairs_within(positions, "100000 ft", digits=2)


def list_in_radius(spark: SparkSession, folder: str) -> DataFrame:
    near = near_point(geo.latest_location(located(spark, folder)))
    return near.orderBy("distance_m", "user_id")


def radius_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near_pairs(geo.latest_location(located(spark, folder)))
    return pairs.orderBy("left_id", "distance_m", "right_id")


def proximity_box(spark: SparkSession, folder: str) -> DataFrame:
    pairs = geo.box_pairs(located(spark, folder), 0.16, 0.165, "30 minutes", "1 minute")
    return _rounded(pairs, 6, "lat_diff", "lon_diff")


def axis_pair_join(spark: SparkSession, folder: str) -> DataFrame:
    pairs = geo.axis_pair_join(located(spark, folder), 0.16, 0.165, "30 minutes", "1 minute")
    return _rounded(pairs, 6, "lat_diff", "lon_diff")


def watched_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every device together with the one that has the next number."""
    devices = events(spark, folder).select(F.col("user_id").alias("left_id")).distinct()
    return devices.withColumn("right_id", F.col("left_id") + 1)


def proximity_named(spark: SparkSession, folder: str) -> DataFrame:
    near = geo.named_proximity(
        located(spark, folder), watched_pairs(spark, folder), "1 day", "6 hours", 1.0
    )
    return _rounded(near, 6, "distance")


def _with_bad_fixes(df: DataFrame) -> DataFrame:
    """Some fixes without a latitude, some without any coordinate, some where the device has not been."""
    bad = F.col("event_id") % 4 == 0
    return df.withColumns(
        {
            "lat": F.when(~bad, F.col("lat")),
            "lon": F.when(~bad | (F.col("event_id") % 8 == 0), F.col("lon")),
        }
    )


def messy_geofence_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return geo.geofence_transitions(_with_bad_fixes(located(spark, folder)), FENCE)


def messy_count_in_radius(spark: SparkSession, folder: str) -> DataFrame:
    """Newest positions within half the circumference: all that are known."""
    newest = geo.latest_location(_with_bad_fixes(located(spark, folder)))
    return geo.count_within(newest, Fence(LATITUDE, LONGITUDE, "21000 km"))


def messy_fence_membership(spark: SparkSession, folder: str) -> DataFrame:
    return geo.inside(_with_bad_fixes(located(spark, folder)), FENCE).select("event_id", "user_id", "inside")


TO_FENCE = distance_sql("lat", "lon", "40.00699e0", "-105.26284e0")

_TRANSITIONS = f"""SELECT user_id, ts, event_id, CASE WHEN now_in THEN 'enter' ELSE 'leave' END AS transition
  FROM (SELECT *, lag(now_in, 1, FALSE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was_in
        FROM (SELECT *, {TO_FENCE} <= 100000 AS now_in FROM loc))
  WHERE now_in <> was_in"""


def _axis_sql(axis: str, limit: float) -> str:
    return f"""SELECT a.user_id AS left_id, b.user_id AS right_id, abs(a.{axis} - b.{axis}) AS d,
           greatest(a.s, b.s) AS f, least(a.s, b.s) + INTERVAL 30 MINUTE AS t
    FROM live a JOIN live b ON a.s < b.s + INTERVAL 30 MINUTE AND b.s < a.s + INTERVAL 30 MINUTE
    WHERE a.user_id <> b.user_id AND abs(a.{axis} - b.{axis}) <= {limit}"""


_BAD = """fixes AS (
  SELECT event_id, user_id, ts, CASE WHEN event_id % 4 <> 0 THEN lat END AS lat,
         CASE WHEN event_id % 4 <> 0 OR event_id % 8 = 0 THEN lon END AS lon FROM loc)"""

QUERIES = {
    "messy_geofence_transitions": Query(
        messy_geofence_transitions,
        f"WITH {LOCATIONS}, {_BAD}, good AS (SELECT * FROM fixes WHERE lat IS NOT NULL AND lon IS NOT NULL) "
        + _TRANSITIONS.replace("FROM loc", "FROM good"),
    ),
    "messy_count_in_radius": Query(
        messy_count_in_radius,
        f"""WITH {LOCATIONS}, {_BAD}
            SELECT count(lat + lon) AS n FROM (SELECT * FROM fixes
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)""",
    ),
    "messy_fence_membership": Query(
        messy_fence_membership,
        f"WITH {LOCATIONS}, {_BAD} SELECT event_id, user_id, {TO_FENCE} <= 100000 AS inside FROM fixes",
    ),
    "latest_location": Query(
        latest_location,
        f"""WITH {LOCATIONS}, {NEWEST_LOCATION}
            SELECT user_id, ts, round(lat, 6) AS lat, round(lon, 6) AS lon FROM newest""",
    ),
    "fence_membership": Query(
        fence_membership,
        f"WITH {LOCATIONS} SELECT event_id, user_id, {TO_FENCE} <= 100000 AS inside FROM loc",
    ),
    "geofence_transitions": Query(geofence_transitions, f"WITH {LOCATIONS} {_TRANSITIONS}"),
    "geofence_transitions_hot": Query(geofence_transitions_hot, f"WITH {LOCATIONS} {_TRANSITIONS}"),
    "geofence_lines": Query(
        geofence_lines,
        f"""WITH {LOCATIONS} SELECT event_id, 'Device ' || user_id || ' is ' ||
              CASE transition WHEN 'enter' THEN 'entering' ELSE 'leaving' END || ' the geofence' AS line
            FROM ({_TRANSITIONS})""",
    ),
    "inside_fence_hop": Query(
        inside_fence_hop,
        f"""WITH {LOCATIONS}
            SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, round(min({TO_FENCE}), 2) AS distance
            FROM {hops("loc", 10, 6)} GROUP BY ws HAVING min({TO_FENCE}) <= 20000""",
    ),
    "count_in_radius": Query(
        count_in_radius,
        f"WITH {LOCATIONS}, {NEWEST_LOCATION} SELECT count(*) AS n FROM newest WHERE {TO_FENCE} <= 100000",
    ),
    "list_in_radius": Query(
        list_in_radius,
        f"""WITH {LOCATIONS}, {NEWEST_LOCATION}
            SELECT user_id, round({TO_FENCE}, 2) AS distance_m FROM newest WHERE {TO_FENCE} <= 100000""",
    ),
    "radius_pairs": Query(
        radius_pairs,
        f"""WITH {LOCATIONS}, {NEWEST_LOCATION}
            SELECT left_id, right_id, round(d, 2) AS distance_m FROM (
              SELECT a.user_id AS left_id, b.user_id AS right_id,
                     {distance_sql("a.lat", "a.lon", "b.lat", "b.lon")} AS d FROM newest a, newest b)
            WHERE d <= 30480""",
    ),
    "proximity_box": Query(
        proximity_box,
        f"""WITH {LOCATIONS}, live AS (SELECT *, date_trunc('minute', ts) AS s FROM loc)
            SELECT a.user_id AS left_id, b.user_id AS right_id, a.event_id AS left_event, b.event_id AS right_event,
                   round(abs(a.lat - b.lat), 6) AS lat_diff, round(abs(a.lon - b.lon), 6) AS lon_diff,
                   greatest(a.s, b.s) AS valid_from, least(a.s, b.s) + INTERVAL 30 MINUTE AS valid_to
            FROM live a JOIN live b ON a.s < b.s + INTERVAL 30 MINUTE AND b.s < a.s + INTERVAL 30 MINUTE
            WHERE a.user_id <> b.user_id AND abs(a.lat - b.lat) <= 0.16 AND abs(a.lon - b.lon) <= 0.165""",
    ),
    "axis_pair_join": Query(
        axis_pair_join,
        f"""WITH {LOCATIONS}, live AS (SELECT *, date_trunc('minute', ts) AS s FROM loc),
              lats AS ({_axis_sql("lat", 0.16)}), lons AS ({_axis_sql("lon", 0.165)})
            SELECT x.left_id, x.right_id, round(x.d, 6) AS lat_diff, round(y.d, 6) AS lon_diff,
                   greatest(x.f, y.f) AS valid_from, least(x.t, y.t) AS valid_to
            FROM lats x JOIN lons y ON x.left_id = y.left_id AND x.right_id = y.right_id
            WHERE x.f < y.t AND y.f < x.t""",
    ),
    "proximity_named": Query(
        proximity_named,
        f"""WITH {LOCATIONS}, last AS (
              SELECT user_id, ws, arg_max(lat, ts) AS lat, arg_max(lon, ts) AS lon
              FROM {hops("loc", 360, 4)} GROUP BY ALL)
            SELECT left_id, right_id, ws AS window_start, ws + INTERVAL 1 DAY AS window_end,
                   round(d, 6) AS distance
            FROM (SELECT a.user_id AS left_id, b.user_id AS right_id, a.ws,
                         sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) AS d
                  FROM last a JOIN last b ON a.ws = b.ws AND b.user_id = a.user_id + 1)
            WHERE d <= 1""",
    ),
}
