"""Parsers, feeds, configuration and filters."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulseline.functions import temporal
from pulseline.functions.geo import metres, metres_of
from pulseline.functions.text import blank_split, parse_double, parse_long, same_text, words
from pulseline.operators import alerts, evaluation, filters
from pulseline.sources import feeds, rules

T0 = datetime(2024, 1, 1)

# Own values in the layout that the configuration must have.
CONFIG = {
    "device_ids": ["pump-1", "pump-2", "valve"],
    "event_types": ["open", "close", "heat", "level"],
    "geofence": {"latitude": "48.5", "longitude": "9.25", "radius": "750 m"},
    "detection": {"latitude": "-33.125", "longitude": "151.0", "radius": "12 km"},
    "temporal": {"time": 45, "frequency": 4},
    "sequence": ["open,heat,close", " open , close"],
    "evaluation": [
        {"event": "heat", "sign": ">", "count": -1, "threshold": 70},
        {"event": "level", "sign": "avg<", "count": 4, "threshold": 3},
    ],
}


@pytest.fixture()
def config(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(CONFIG, indent=2))
    return rules.read_config(spark, str(path))


def test_config(config):
    assert [r["device_id"] for r in rules.devices(config).collect()] == CONFIG["device_ids"]
    assert rules.series(config).count() == 3 * 4
    assert rules.patterns(config) == [["open", "heat", "close"], ["open", "close"]]
    assert rules.fence(config) == rules.Fence(-33.125, 151.0, "12 km")
    assert rules.fence(config, "geofence").radius == "750 m"
    first, second = rules.eval_rules(config)
    assert (first.samples, second.samples) == (10, 4)
    assert first == rules.EvalRule("heat", ">", -1, 70)


def test_rules_on_events(spark, config):
    rows = [(i, T0, "valve", "heat", float(v)) for i, v in enumerate([69, 70, 71, 72.9])]
    rows += [(100 + i, T0, "valve", "level", 2.9) for i in range(4)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, device string, event_type string, value double")
    got = evaluation.evaluate_rules(df, rules.eval_rules(config), "device").collect()
    assert sorted((r["event"], r["measure"]) for r in got) == [("heat", 71), ("heat", 72), ("level", 2)]
    with pytest.raises(ValueError):
        evaluation.evaluate_rules(df, [])


def test_json_lines(spark, tmp_path):
    lines = [
        {"DeviceID": 7, "Timestamp": "2024-01-01T00:00:01Z", "EventID": 2, "EventData": "1.5 2.5 9", "IsTemporal": True},
        {"Timestamp": "2024-01-01T00:00:02Z", "EventData": "bad"},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    rows = feeds.json_files(spark, str(tmp_path / "in"), streaming=False).orderBy("ts").collect()
    assert (rows[0]["device_id"], rows[0]["event_type"], tuple(rows[0]["location"])) == (7, 2, (1.5, 2.5, 9))
    assert (rows[1]["device_id"], rows[1]["event_type"], rows[1]["location"], rows[1]["is_temporal"]) == (0, 0, None, False)
    assert feeds.json_files(spark, str(tmp_path / "in")).isStreaming


def test_text_records(spark):
    raw = spark.createDataFrame([(b"geo", b"a 1 2", T0)], "key binary, value binary, timestamp timestamp")
    row = feeds.decode_text(raw).first()
    assert (row["key"], row["value"], row["ts"]) == ("geo", "a 1 2", T0)


def test_geo_messages(spark):
    df = spark.createDataFrame([("GEO", "a 1 2"), ("geo", "B 1 2"), ("x", "a 1 2")], "key string, value string")
    assert filters.geo_messages(df).count() == 2
    assert [r["value"] for r in filters.geo_messages(df, "b").collect()] == ["B 1 2"]


def test_series_filter(spark):
    rows = [(1, "A"), (1, "B"), (2, "A")]
    df = spark.createDataFrame(rows, "user_id long, event_type string")
    assert filters.of_series(df, ["A"], F.col("user_id"), 1).count() == 1


def test_scalars(spark):
    df = spark.createDataFrame([(" a  b ",)], "v string")
    row = df.select(
        words(F.lit("a  b")).alias("w"),
        blank_split(F.lit("a  b")).alias("b"),
        same_text(F.lit("AbC"), "aBc").alias("same"),
        parse_long(F.lit("+7")).alias("plus"),
        parse_long(F.lit("99999999999999999999")).alias("too_long"),
        parse_double(F.lit("1e3")).alias("exp"),
        parse_double(F.lit("NaN")).alias("nan"),
        metres_of(F.lit("2 KM")).alias("km"),
        metres_of(F.lit("2 yd")).alias("yd"),
    ).first()
    assert (row["w"], row["b"], row["same"]) == (["a", "b"], ["a", "", "b"], True)
    assert (row["plus"], row["too_long"], row["exp"], row["nan"]) == (7, None, 1000.0, None)
    assert (row["km"], row["yd"], metres("500 ft")) == (2000.0, None, pytest.approx(152.4))


def test_durations():
    assert temporal.duration("1 hour 30 minutes") == 5_400_000_000
    for bad in ("", "5", "five minutes", "5 fortnights", "0 seconds"):
        with pytest.raises(ValueError):
            temporal.duration(bad)


def test_bins_before_1970(spark):
    df = spark.createDataFrame([(datetime(1969, 12, 31, 23, 59, 59),)], "ts timestamp")
    assert df.select(temporal.bin_of(F.col("ts"), 10_000_000).alias("b")).first()["b"] == -1


def test_lifetimes(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 7, 500_000),)], "ts timestamp")
    alive = temporal.hop_lifetime(df, "8 seconds", "1 second").first()
    assert (alive["valid_from"].second, alive["valid_to"].second) == (7, 15)
    shifted = temporal.shift_lifetime(temporal.interval_lifetime(df, "5 seconds"), "1 second", "2 seconds").first()
    assert (shifted["valid_to"] - shifted["valid_from"]).total_seconds() == 2


def test_topics(spark):
    df = spark.createDataFrame([("a",)], "letter string")
    assert alerts.route_by_type(df, F.col("letter")).first()["topic"] == "type-A"
