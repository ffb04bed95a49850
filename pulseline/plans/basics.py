"""Filters, parsers, ingest shapes, catalogue and rule queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.functions import avro, temporal, text
from pulseline.functions.geo import metres_of
from pulseline.operators import alerts, evaluation, filters
from pulseline.plans.registry import LETTERS, A, B, C, D, E, Query
from pulseline.session import work_dir
from pulseline.sources import feeds, rules
from pulseline.sources.tables import events, load, with_fix_text, with_location

ALL_TYPES = [A, B, C, D, E]
# Event type as the number the typed feeds use.
TYPE_NUMBER = {A: 0, B: 1, C: 2, D: 3, E: 4}


def _lookup(table: dict[str, object]):
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), F.col("event_type"))


def _case(table: dict[str, object]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items())
    return f"CASE event_type {whens} END"


def filter_event_type(spark: SparkSession, folder: str) -> DataFrame:
    return filters.of_types(events(spark, folder), "ViEw").select("event_id", "ts", "user_id", "event_type")


def filter_event_types(spark: SparkSession, folder: str) -> DataFrame:
    kept = filters.of_types(events(spark, folder), "VIEW", "Click", "purchase", "signup")
    return kept.select("event_id", "event_type")


def evaluation_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return filters.above(events(spark, folder), "value", 10).select("event_id", "user_id", "value")


def evaluation_lifetime(spark: SparkSession, folder: str) -> DataFrame:
    hits = filters.above(events(spark, folder), "value", 20)
    alive = temporal.hop_lifetime(hits, "10 minutes", "1 minute")
    return alive.select("user_id", "event_id", "valid_from", "valid_to")


def _number_text(df: DataFrame) -> DataFrame:
    """Numbers as messages: plain, padded with blanks, with a fraction, and signed."""
    k = F.get_json_object("props", "$.k").cast("int")
    digits = k.cast("string")
    forms = (
        F.when(k % 4 == 0, digits)
        .when(k % 4 == 1, F.concat(F.lit(" "), digits, F.lit(" ")))
        .when(k % 4 == 2, F.concat(digits, F.lit(".5")))
        .otherwise(F.concat(F.lit("+"), digits))
    )
    return df.withColumns({"k": k, "message": forms})


def evaluation_text(spark: SparkSession, folder: str) -> DataFrame:
    return filters.text_above(_number_text(events(spark, folder)), "message", 10).select(
        "event_id", "message"
    )


def scalar_parsers(spark: SparkSession, folder: str) -> DataFrame:
    df = _number_text(events(spark, folder))
    unit = F.element_at(
        F.array(*[F.lit(u) for u in ("m", "km", "ft", "mi")]), (F.col("k") % 4 + 1).cast("int")
    )
    sentence = F.concat_ws("  ", F.initcap("event_type"), F.col("k").cast("string"), F.lit("x"))
    return df.select(
        "event_id",
        text.same_text(F.initcap("event_type"), "VIEW").alias("is_view"),
        F.size(text.words(sentence)).cast("bigint").alias("word_count"),
        F.size(text.blank_split(sentence)).cast("bigint").alias("blank_count"),
        text.parse_long(F.col("message")).alias("whole"),
        text.parse_double(F.col("message")).alias("number"),
        F.timestamp_seconds(F.col("event_id")).alias("from_epoch"),
        F.to_timestamp(F.concat(F.lit("2024-01-01T00:00:"), F.format_string("%02d", F.col("k") % 60))).alias(
            "from_text"
        ),
        F.round(metres_of(F.concat_ws(" ", F.col("k").cast("string"), unit)), 4).alias("metres"),
    )


def parse_location(spark: SparkSession, folder: str) -> DataFrame:
    messages = with_fix_text(events(spark, folder)).withColumn("value", F.col("value_text"))
    fix = text.parse_fix(F.col("value"))
    return (
        filters.geo_messages(messages)
        .select("event_id", fix.alias("fix"))
        .select("event_id", "fix.object_id", F.round("fix.lat", 4).alias("lat"), F.round("fix.lon", 4).alias("lon"))
    )


def route_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.route_by_type(events(spark, folder), _lookup(LETTERS)).select("event_id", "topic")


def json_ingest(spark: SparkSession, folder: str) -> DataFrame:
    parsed = events(spark, folder).select(
        "event_id", "user_id", "ts", "event_type", F.from_json("props", "k INT").alias("p")
    )
    return parsed.select("event_id", "user_id", "ts", "event_type", "p.k")


def json_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as JSON messages and read back; some lack fields, some locations are bad."""
    df = with_location(events(spark, folder))
    k = F.get_json_object("props", "$.k").cast("int")
    fix = F.concat_ws(" ", F.format_string("%.2f", "lat"), F.format_string("%.2f", "lon"), k.cast("string"))
    message = F.to_json(
        F.struct(
            F.when(k % 5 != 0, F.col("user_id").cast("int")).alias("DeviceID"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("Timestamp"),
            _lookup(TYPE_NUMBER).alias("EventID"),
            F.when(k % 3 != 0, fix).otherwise(F.lit("nowhere")).alias("EventData"),
            F.when(k % 2 == 0, F.lit(True)).alias("IsTemporal"),
        )
    )
    decoded = feeds.decode_json(df.select(message.alias("value")))
    return decoded.select(
        "device_id",
        "ts",
        "event_type",
        F.round("location.latitude", 4).alias("latitude"),
        F.round("location.longitude", 4).alias("longitude"),
        F.col("location.accuracy").cast("int").alias("accuracy"),
        "is_temporal",
    )


def avro_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as an Avro feed brings them, byte by byte, and read back as typed columns."""
    df = with_location(events(spark, folder))
    k = F.get_json_object("props", "$.k").cast("int")
    nested = df.select(
        F.col("user_id").cast("int").alias("DeviceID"),
        F.unix_seconds("ts").alias("Timestamp"),
        _lookup(TYPE_NUMBER).alias("EventID"),
        F.struct(
            F.col("lat").cast("float").alias("Latitude"),
            F.col("lon").cast("float").alias("Longitude"),
            k.alias("Accuracy"),
        ).alias("EventData"),
    )
    records = nested.select(avro.encoded(F.struct("*"), feeds.AVRO_EVENT_SCHEMA).alias("value"))
    return feeds.decode_avro(records).select(
        "device_id",
        "ts",
        "event_type",
        F.round(F.col("latitude").cast("double"), 3).alias("latitude"),
        F.round(F.col("longitude").cast("double"), 3).alias("longitude"),
        "accuracy",
        "is_temporal",
    )


def dedup_max(spark: SparkSession, folder: str) -> DataFrame:
    daily = events(spark, folder).withColumn("day", F.date_trunc("day", "ts"))
    return filters.largest_per_instant(daily, ["user_id", "event_type", "day"])


def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    daily = events(spark, folder).withColumn("day", F.date_trunc("day", "ts"))
    return filters.first_per_instant(daily, ["user_id", "event_type", "day"])


def latest_sample(spark: SparkSession, folder: str) -> DataFrame:
    return filters.latest(events(spark, folder), ["user_id", "event_type"], ["ts", "value"])


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    customers = load(spark, folder, "customer")
    return customers.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("user_id"))


def registered_devices(spark: SparkSession, folder: str) -> DataFrame:
    kept = filters.registered(events(spark, folder), _registry(spark, folder), "user_id")
    return kept.select("event_id", "user_id")


def rejected_devices(spark: SparkSession, folder: str) -> DataFrame:
    rejected = filters.registered(events(spark, folder), _registry(spark, folder), "user_id", known=False)
    return rejected.select("event_id", "user_id")


def series_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return filters.series_counts(events(spark, folder), ALL_TYPES)


def last_seen_times(spark: SparkSession, folder: str) -> DataFrame:
    return filters.last_seen(events(spark, folder), ALL_TYPES)


def retained_events(spark: SparkSession, folder: str) -> DataFrame:
    return filters.retained(events(spark, folder), "7 days").select("event_id", "ts")


def avg_last_n(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.average_of_last(events(spark, folder), C, 10, 50)


def last_n_above(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.last_n_above(events(spark, folder), E, 10)


EVAL_RULES = [rules.EvalRule(E, ">", -1, 10), rules.EvalRule(C, "avg<", 10, 50)]


def rule_table(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.evaluate_rules(events(spark, folder), EVAL_RULES)


def filter_series(spark: SparkSession, folder: str) -> DataFrame:
    """Some types of one device: the one with the most events, the smallest id if several have."""
    seen = events(spark, folder)
    busiest = seen.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()
    kept = filters.of_series(seen, [A, E], F.col("user_id"), busiest["user_id"] if busiest else None)
    return kept.select("event_id", "user_id", "event_type")


def registered_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Every registered device with every type, whether it has sent an event or not."""
    return filters.registered_series(_registry(spark, folder), events(spark, folder), ALL_TYPES)


# A configuration document as it would lie in the shared store.
CONFIG_DOCUMENT = {
    "device_ids": ["1", "2", "3"],
    "event_types": ALL_TYPES,
    "evaluation": [
        {"event": E, "sign": ">", "count": -1, "threshold": 40},
        {"event": E, "sign": ">", "count": 25, "threshold": 40},
        {"event": C, "sign": "avg<", "count": 5, "threshold": 45},
    ],
}


def configured_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of a configuration document, which is written and read back."""
    path = work_dir(spark, "configuration")
    spark.createDataFrame([(json.dumps(CONFIG_DOCUMENT),)], "value string").write.text(path)
    rule_list = rules.eval_rules(rules.read_config(spark, path))
    return evaluation.evaluate_rules(events(spark, folder), rule_list)


def messy(df: DataFrame, ties: bool = True) -> DataFrame:
    """Events as feeds also bring them: no value, values beyond 32 and beyond 64 bits, times that tie."""
    number = F.col("event_id")
    value = (
        F.when(number % 7 == 0, None)
        .when(number % 11 == 0, F.lit(3e9))
        .when(number % 13 == 0, F.lit(-1e30))
        .otherwise(F.col("value"))
    )
    return df.withColumns({"value": value} | ({"ts": F.date_trunc("day", "ts")} if ties else {}))


def messy_last_n_above(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.last_n_above(messy(events(spark, folder)), E, 10)


def messy_avg_last_n(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.average_of_last(messy(events(spark, folder)), C, 10, 50)


def messy_rule_table(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.evaluate_rules(messy(events(spark, folder)), EVAL_RULES)


def threshold_cross_up(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.threshold_cross_up(events(spark, folder), 42, ["user_id"])


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_MESSAGE = f"""CASE {_K} % 4 WHEN 0 THEN CAST({_K} AS VARCHAR) WHEN 1 THEN ' ' || {_K} || ' '
        WHEN 2 THEN {_K} || '.5' ELSE '+' || {_K} END"""
_WHOLE = f"CASE WHEN {_K} % 4 IN (0, 3) THEN CAST({_K} AS BIGINT) END"
_POSITION = f"""39e0 + {_K} * 3e-2 AS lat, -107e0 + ((event_id * 37) % 170) * 1e-2 AS lon"""
_LAST_TEN = """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
  FROM events WHERE event_type = '{kind}'"""

# The same on the SQL side; values that are no samples drop out.
MESSY = """messy AS (
  SELECT event_id, user_id, event_type, date_trunc('day', ts) AS ts,
         CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 3e9
              WHEN event_id % 13 = 0 THEN -1e30 ELSE value END AS value
  FROM events)"""


def _newest(source: str, kind: str, n: int) -> str:
    """The newest ``n`` samples of a type per device, as whole numbers."""
    return f"""(SELECT user_id, event_id, ts, trunc(value) AS whole FROM {source}
        WHERE event_type = '{kind}' AND abs(value) < 9e18
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= {n})"""


def _above_sql(number: int, source: str, n: int, threshold: int) -> str:
    return f"""SELECT {number} AS rule_id, 'error' AS event, '>' AS sign, user_id, event_id,
        CAST(whole AS BIGINT) AS measure FROM {_newest(source, E, n)} WHERE whole > {threshold}"""


def _average_sql(source: str, n: int, threshold: int) -> str:
    return f"""SELECT user_id, CAST(trunc(sum(whole) / {n}) AS BIGINT) AS average FROM {_newest(source, C, n)}
        GROUP BY user_id HAVING count(*) = {n} AND trunc(sum(whole) / {n}) < {threshold}"""


QUERIES = {
    "filter_series": Query(
        filter_series,
        """SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('view', 'error') AND user_id =
           (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)""",
    ),
    "registered_catalogue": Query(
        registered_catalogue,
        """SELECT c.c_custkey AS user_id, t.event_type, count(e.event_id) AS n
           FROM customer c CROSS JOIN (SELECT DISTINCT event_type FROM events) t
           LEFT JOIN events e ON e.user_id = c.c_custkey AND e.event_type = t.event_type
           WHERE c.c_acctbal > 0 GROUP BY ALL""",
    ),
    "configured_rules": Query(
        configured_rules,
        f"""{_above_sql(0, "events", 10, 40)} UNION ALL {_above_sql(1, "events", 25, 40)} UNION ALL
            SELECT 2, 'purchase', 'avg<', user_id, NULL, average FROM ({_average_sql("events", 5, 45)})""",
    ),
    "messy_last_n_above": Query(
        messy_last_n_above,
        f"""WITH {MESSY} SELECT user_id, event_id, ts, CAST(whole AS BIGINT) AS whole_value
            FROM {_newest("messy", E, 10)} WHERE whole > 10""",
    ),
    "messy_avg_last_n": Query(messy_avg_last_n, f"WITH {MESSY} {_average_sql('messy', 10, 50)}"),
    "messy_rule_table": Query(
        messy_rule_table,
        f"""WITH {MESSY} {_above_sql(0, "messy", 10, 10)} UNION ALL
            SELECT 1, 'purchase', 'avg<', user_id, NULL, average FROM ({_average_sql("messy", 10, 50)})""",
    ),
    "filter_event_type": Query(
        filter_event_type,
        "SELECT event_id, ts, user_id, event_type FROM events WHERE event_type ILIKE 'VIEW'",
    ),
    "filter_event_types": Query(
        filter_event_types,
        "SELECT event_id, event_type FROM events WHERE event_type <> 'error'",
    ),
    "evaluation_threshold": Query(
        evaluation_threshold, "SELECT event_id, user_id, value FROM events WHERE value > 10"
    ),
    "evaluation_lifetime": Query(
        evaluation_lifetime,
        """SELECT user_id, event_id, date_trunc('minute', ts) AS valid_from,
                  date_trunc('minute', ts) + INTERVAL 10 MINUTE AS valid_to
           FROM events WHERE value > 20""",
    ),
    "evaluation_text": Query(
        evaluation_text,
        f"SELECT event_id, {_MESSAGE} AS message FROM events WHERE {_K} % 4 IN (0, 3) AND {_K} > 10",
    ),
    "scalar_parsers": Query(
        scalar_parsers,
        f"""SELECT event_id, event_type = 'view' AS is_view,
                   CAST(3 AS BIGINT) AS word_count, CAST(5 AS BIGINT) AS blank_count,
                   {_WHOLE} AS whole,
                   CASE {_K} % 4 WHEN 1 THEN NULL WHEN 2 THEN {_K} + 5e-1 ELSE CAST({_K} AS DOUBLE) END AS number,
                   TIMESTAMP '1970-01-01' + event_id * INTERVAL 1 SECOND AS from_epoch,
                   TIMESTAMP '2024-01-01' + ({_K} % 60) * INTERVAL 1 SECOND AS from_text,
                   round({_K} * CASE {_K} % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 1e3 WHEN 2 THEN 3048e-4
                                ELSE 160934e-2 END, 4) AS metres
            FROM events""",
    ),
    "parse_location": Query(
        parse_location,
        f"""SELECT event_id, CAST(user_id AS VARCHAR) AS object_id, round(lat, 4) AS lat, round(lon, 4) AS lon
            FROM (SELECT event_id, user_id, {_POSITION} FROM events)""",
    ),
    "route_by_type": Query(
        route_by_type, f"SELECT event_id, 'type-' || {_case(LETTERS)} AS topic FROM events"
    ),
    "json_ingest": Query(
        json_ingest, f"SELECT event_id, user_id, ts, event_type, {_K} AS k FROM events"
    ),
    "json_events": Query(
        json_events,
        f"""SELECT CASE WHEN k % 5 <> 0 THEN CAST(user_id AS INT) ELSE 0 END AS device_id, ts,
                   CAST({_case(TYPE_NUMBER)} AS INT) AS event_type,
                   CASE WHEN k % 3 <> 0 THEN round(lat, 4) END AS latitude,
                   CASE WHEN k % 3 <> 0 THEN round(lon, 4) END AS longitude,
                   CASE WHEN k % 3 <> 0 THEN k END AS accuracy,
                   k % 2 = 0 AS is_temporal
            FROM (SELECT *, {_K} AS k, {_POSITION} FROM events)""",
    ),
    "avro_events": Query(
        avro_events,
        f"""SELECT CAST(user_id AS INT) AS device_id, date_trunc('second', ts) AS ts,
                   CAST({_case(TYPE_NUMBER)} AS INT) AS event_type, round(lat, 3) AS latitude,
                   round(lon, 3) AS longitude, k AS accuracy, TRUE AS is_temporal
            FROM (SELECT *, {_K} AS k, {_POSITION} FROM events)""",
    ),
    "dedup_max": Query(
        dedup_max,
        """SELECT user_id, event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, max(value) AS value
           FROM events GROUP BY ALL""",
    ),
    "dedup_first": Query(
        dedup_first,
        """SELECT user_id, event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, value, event_id
           FROM events QUALIFY row_number() OVER (
             PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY event_id) = 1""",
    ),
    "latest_sample": Query(
        latest_sample,
        """SELECT user_id, event_type, ts, value FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    ),
    "registered_devices": Query(
        registered_devices,
        """SELECT event_id, user_id FROM events
           WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    ),
    "rejected_devices": Query(
        rejected_devices,
        """SELECT event_id, user_id FROM events
           WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    ),
    "series_catalogue": Query(
        series_catalogue,
        """SELECT u.user_id, t.event_type, count(e.event_id) AS n
           FROM (SELECT DISTINCT user_id FROM events) u
           CROSS JOIN (SELECT DISTINCT event_type FROM events) t
           LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type
           GROUP BY ALL""",
    ),
    "last_seen_times": Query(
        last_seen_times,
        "SELECT user_id, "
        + ", ".join(f"max(ts) FILTER (event_type = '{t}') AS last_{t}" for t in ALL_TYPES)
        + " FROM events GROUP BY user_id",
    ),
    "retained_events": Query(
        retained_events,
        "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
    ),
    "avg_last_n": Query(
        avg_last_n,
        f"""SELECT user_id, CAST(trunc(sum(trunc(value)) / 10) AS BIGINT) AS average
            FROM ({_LAST_TEN.format(kind=C)}) WHERE r <= 10 GROUP BY user_id
            HAVING count(*) = 10 AND trunc(sum(trunc(value)) / 10) < 50""",
    ),
    "last_n_above": Query(
        last_n_above,
        f"""SELECT user_id, event_id, ts, CAST(trunc(value) AS BIGINT) AS whole_value
            FROM ({_LAST_TEN.format(kind=E)}) WHERE r <= 10 AND trunc(value) > 10""",
    ),
    "rule_table": Query(
        rule_table,
        f"""SELECT 0 AS rule_id, 'error' AS event, '>' AS sign, user_id, event_id,
                   CAST(trunc(value) AS BIGINT) AS measure
            FROM ({_LAST_TEN.format(kind=E)}) WHERE r <= 10 AND trunc(value) > 10
            UNION ALL
            SELECT 1, 'purchase', 'avg<', user_id, NULL, CAST(trunc(sum(trunc(value)) / 10) AS BIGINT)
            FROM ({_LAST_TEN.format(kind=C)}) WHERE r <= 10 GROUP BY user_id
            HAVING count(*) = 10 AND trunc(sum(trunc(value)) / 10) < 50""",
    ),
    "threshold_cross_up": Query(
        threshold_cross_up,
        """SELECT user_id, event_id, ts, low, value AS high
           FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS low FROM events)
           WHERE value > 42 AND low < 42""",
    ),
}
