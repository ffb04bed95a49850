"""Small cases with known answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseline.functions.text import parse_fix, parse_location
from pulseline.operators import evaluation, filters, geo, joins, liveness, sequences, windows
from pulseline.sources.rules import Fence

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def stream_of(spark, kinds, step=1.0, user=1):
    rows = [(i, at(i * step), user, k) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")


def timed(spark, rows):
    """Rows of (seconds, type) of one user, in arrival order."""
    data = [(i, at(s), 1, k) for i, (s, k) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string")


def samples(spark, values, kind="F"):
    rows = [(i, at(i), 1, kind, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "event_id long, ts timestamp, user_id long, event_type string, value double"
    )


SENSOR = [(1, 0), (2, 20), (3, 15), (4, 30), (5, 45), (6, 50), (7, 30), (8, 35), (9, 60), (10, 20)]


def test_threshold_crossed_upward(spark):
    df = spark.createDataFrame(SENSOR, "time int, value int")
    rows = joins.previous_tick(df, "time", 42).collect()
    assert sorted(tuple(r) for r in rows) == [(5, 30, 45), (9, 35, 60)]


def test_threshold_comparisons_are_strict(spark):
    df = spark.createDataFrame([(1, 42), (2, 50)], "time int, value int")
    assert joins.previous_tick(df, "time", 42).count() == 0


def test_frequency_one_alert_per_window(spark):
    hits = windows.event_frequency(stream_of(spark, "AaA"), "a", 3, "5 seconds", "1 second")
    rows = hits.orderBy("window_start").collect()
    # Events at 0, 1 and 2 s: windows that start at -2, -1 and 0 s hold all three.
    assert [(r["window_start"], r["n"]) for r in rows] == [(at(-2), 3), (at(-1), 3), (at(0), 3)]


@pytest.mark.parametrize(
    ("first", "second", "alert"), [(0, 3.9, True), (0.5, 4.9, True), (0.5, 5.2, False), (0, 5, False)]
)
def test_followed_within_gap(spark, first, second, alert):
    df = timed(spark, [(first, "A"), (second, "B")])
    found = windows.followed_within(df, "a", "b", "5 seconds", "1 second")
    assert (found.count() > 0) == alert


def test_followed_needs_order(spark):
    df = timed(spark, [(0, "B"), (1, "A")])
    assert windows.followed_within(df, "a", "b", "5 seconds", "1 second").count() == 0


def test_text_evaluation(spark):
    df = spark.createDataFrame([(v,) for v in ["11", "10", "-5", "abc", "12.5", " 12 "]], "value string")
    assert [r["value"] for r in filters.text_above(df, "value", 10).collect()] == ["11"]


def fsm(spark, kinds):
    rows = sequences.sequence_fsm(
        stream_of(spark, kinds, step=0.1), ("a", "b", "c", "d"), "5 seconds", "5 seconds"
    ).collect()
    return sorted((r["event_id"], r["state"]) for r in rows)


@pytest.mark.parametrize(
    ("kinds", "hits"),
    [
        ("ABCD", [(2, 3), (3, 4)]),
        ("ABxC", [(3, 3)]),
        ("ABABC", [(4, 3)]),
        ("ABCB", [(2, 3)]),
        ("abcdA", [(2, 3), (3, 4), (4, 4)]),
    ],
)
def test_state_machine(spark, kinds, hits):
    assert fsm(spark, kinds) == hits


def test_consecutive_sequence(spark):
    df = stream_of(spark, "ABCD")
    rows = sequences.match_sequence(df, ["A", "B", "C"], "60 seconds").collect()
    assert [(r["step_1_id"], r["step_3_id"]) for r in rows] == [(0, 2)]
    assert sequences.match_sequence(df, ["A", ["B", "C"], "D"], "60 seconds").count() == 0


def test_sequence_bound_is_inclusive(spark):
    df = timed(spark, [(0, "A"), (60, "B"), (120, "C")])
    assert sequences.match_sequence(df, ["A", "B", "C"], "60 seconds").count() == 1
    assert sequences.match_sequence(df, ["A", "B", "C"], "59 seconds").count() == 0


def test_last_seen_order(spark):
    tie = timed(spark, [(1, "A"), (2, "B"), (2, "C")])
    assert sequences.last_seen_order(tie, [["A", "B", "C"]]).count() == 1
    gap = timed(spark, [(1, "A"), (2, "C")])
    assert sequences.last_seen_order(gap, [["A", "B", "C"]]).count() == 0
    assert sequences.last_seen_order(tie, [["A", "B"]], max_gap="500 milliseconds").count() == 0


def located(spark, fixes):
    rows = [(i, at(s), d, lat, lon) for i, (s, d, lat, lon) in enumerate(fixes)]
    return spark.createDataFrame(
        rows, "event_id long, ts timestamp, user_id long, lat double, lon double"
    )


def test_box_pairs(spark):
    df = located(
        spark, [(0, 1, 40.24, 55.30), (1, 2, 42.24, 56.30), (2, 3, 30.24, 65.30), (3, 4, 20.24, 75.30)]
    )
    pairs = geo.box_pairs(df, 15.0, 15.0, "30 seconds", "1 second")
    unordered = [(1, 2), (1, 3), (2, 3), (3, 4)]
    want = sorted(unordered + [(b, a) for a, b in unordered])
    assert sorted((r["left_id"], r["right_id"]) for r in pairs.collect()) == want


GEO_FIXES = [(0, 2, 4.0, 4.0), (0.1, 2, 5.0, 5.0), (0.2, 1, 0.0, 0.0), (0.3, 1, 1.0, 1.0), (0.4, 1, 2.0, 2.0)]


def test_named_proximity(spark):
    pairs = spark.createDataFrame([(1, 2)], "left_id long, right_id long")
    near = geo.named_proximity(located(spark, GEO_FIXES), pairs, "5 seconds", "5 seconds", 100.0)
    assert [round(r["distance"], 4) for r in near.collect()] == [4.2426]


def test_nearest_to_point(spark):
    df = located(spark, GEO_FIXES)
    distance = F.sqrt(F.col("lat") ** 2 + F.col("lon") ** 2)
    rows = windows.nearest_to_point(df, distance, "5 seconds", "5 seconds", 10.0).collect()
    assert [r["distance"] for r in rows] == [0.0]


def test_malformed_positions_are_null(spark):
    df = spark.createDataFrame([("a 1",), ("a 1 x",), ("a 1 2",), ("a  1.5   -2",)], "v string")
    got = [r["f"] and tuple(r["f"]) for r in df.select(parse_fix(F.col("v")).alias("f")).collect()]
    assert got == [None, None, ("a", 1.0, 2.0), ("a", 1.5, -2.0)]


def test_location_text(spark):
    df = spark.createDataFrame([("1.5 2 255",), ("1.5 2 256",), ("1.5 2",), ("1 2 -1",), ("1 2 99999",)], "v string")
    got = [r["f"] and tuple(r["f"]) for r in df.select(parse_location(F.col("v")).alias("f")).collect()]
    assert got == [(1.5, 2.0, 255), None, None, None, None]


FENCE = Fence(0.0, 0.0, "1 km")


def moves(spark, inside):
    fixes = [(i, 1, 0.0 if here else 1.0, 0.0) for i, here in enumerate(inside)]
    rows = geo.geofence_transitions(located(spark, fixes), FENCE).orderBy("event_id").collect()
    return [(r["event_id"], r["transition"]) for r in rows]


def test_geofence(spark):
    assert moves(spark, [False, True, True, False]) == [(1, "enter"), (3, "leave")]
    assert moves(spark, [True]) == [(0, "enter")]


def test_average_needs_all_samples(spark):
    assert evaluation.average_of_last(samples(spark, [1] * 9), "F", 10, 10).count() == 0
    assert evaluation.average_of_last(samples(spark, [1] * 10), "F", 10, 10).count() == 1


def test_average_is_cut_toward_zero(spark):
    df = samples(spark, [-5] + [0] * 9)
    assert evaluation.average_of_last(df, "F", 10, 0).count() == 0
    assert evaluation.average_of_last(df, "F", 10, 1).first()["average"] == 0


def test_limit_before_predicate(spark):
    df = samples(spark, [99, 99] + [10] * 10, "E")
    assert evaluation.last_n_above(df, "E", 10).count() == 0


def test_lookback(spark):
    df = timed(spark, [(100, "A"), (95, "B"), (105, "B")])
    assert [r["ts"] for r in joins.lookback(df, "A", "B", "10 seconds").collect()] == [at(95)]
    after = joins.lookback(df, "A", "B", "10 seconds", direction="after")
    assert [r["ts"] for r in after.collect()] == [at(105)]
    with pytest.raises(ValueError):
        joins.lookback(df, "A", "B", "10 seconds", direction="around")


def test_late_events(spark):
    rows = [(i, at(s)) for i, s in enumerate([1, 3, 2, 4])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp")
    kept = liveness.drop_late(df, "event_id")
    assert sorted(r["ts"] for r in kept.collect()) == [at(1), at(3), at(4)]
    with pytest.raises(Exception, match="out of order"):
        liveness.require_order(df, "event_id").collect()
    assert liveness.require_order(kept, "event_id").count() == 3


def test_ties_are_not_late(spark):
    df = spark.createDataFrame([(0, at(1)), (1, at(1))], "event_id long, ts timestamp")
    assert liveness.drop_late(df, "event_id").count() == 2


@pytest.mark.parametrize(("silence", "states"), [(180, []), (181, ["OVER"]), (243, ["FAIL", "OVER"])])
def test_silence(spark, silence, states):
    df = timed(spark, [(0, "A"), (silence, "A")])
    rows = liveness.device_liveness(df).collect()
    assert sorted(r["status"] for r in rows) == states


def test_trailing_silence(spark):
    df = timed(spark, [(0, "A")])
    rows = liveness.device_liveness(df, as_of=F.lit(at(200))).collect()
    assert [(r["status"], r["since"], r["next_seen"]) for r in rows] == [("OVER", at(181), None)]
