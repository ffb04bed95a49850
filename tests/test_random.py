"""Operators against plain definitions on random input, with hot keys and small task budgets."""

import itertools
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseline.functions.geo import EARTH_RADIUS_M
from pulseline.operators import geo, joins, liveness, sequences, skew, windows
from pulseline.operators.skew import Budget, salted_join, with_previous

T0 = datetime(2024, 1, 1)
BUDGETS = [Budget(), Budget(40, "10 seconds"), Budget(3, "1 minute"), Budget(2, "7 seconds")]


def random_events(seed, n=400, span=200, users=5):
    """A third of the rows belongs to user 0, and a third of all rows to one second."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if rng.random() < 0.34 else rng.randrange(users)
        second = 50 + rng.random() if rng.random() < 0.34 else rng.uniform(0, span)
        # Whole tenths of seconds make ties common.
        rows.append((i, T0 + timedelta(milliseconds=round(second * 10) * 100), user, rng.choice("abcd")))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")


def micros(ts):
    return (ts - datetime(1970, 1, 1)) // timedelta(microseconds=1)


@pytest.mark.parametrize("budget", BUDGETS)
@pytest.mark.parametrize("by_user", [False, True])
def test_previous(spark, budget, by_user):
    rows = random_events(1)
    keys = ["user_id"] if by_user else []
    got = with_previous(frame(spark, rows), ["event_id"], keys, 2, budget=budget).collect()
    assert len(got) == len(rows)
    want = {}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        chain = groups.setdefault(r[2] if by_user else None, [None, None])
        want[r[0]] = (chain[-1], chain[-2])
        chain.append(r[0])
    for r in got:
        assert tuple(p and p["event_id"] for p in (r["prev_1"], r["prev_2"])) == want[r["event_id"]]


NEXT = {
    0: {"a": 1},
    1: {"a": 1, "b": 2},
    2: {"a": 1, "c": 3},
    3: {"a": 1, "d": 4},
    4: {k: 4 for k in "abcd"},
}


@pytest.mark.parametrize("budget", BUDGETS)
def test_state_machine_is_the_fold(spark, budget):
    rows = random_events(2, n=600)
    got = sequences.sequence_fsm(
        frame(spark, rows), ("a", "b", "c", "d"), "20 seconds", "5 seconds", budget=budget
    ).collect()
    want = set()
    low, high = micros(T0) // 5_000_000 - 4, micros(T0) // 5_000_000 + 45
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for w in range(low, high):
        state = 0
        for r in ordered:
            if w * 5_000_000 <= micros(r[1]) < w * 5_000_000 + 20_000_000:
                state = NEXT[state].get(r[3], 0)
                if state >= 3:
                    want.add((w, r[0], state))
    assert len(got) == len(want) > 50
    assert {(micros(r["window_start"]) // 5_000_000, r["event_id"], r["state"]) for r in got} == want


@pytest.mark.parametrize("budget", BUDGETS)
def test_sequence_match(spark, budget):
    rows = random_events(3)
    got = sequences.match_sequence(
        frame(spark, rows), ["a", ["b", "c"], "d"], "1 second", budget=budget
    ).collect()
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    want = [
        (x[0], y[0], z[0])
        for x, y, z in zip(ordered, ordered[1:], ordered[2:])
        if x[3] == "a" and y[3] in "bc" and z[3] == "d"
        and y[1] - x[1] <= timedelta(seconds=1) and z[1] - y[1] <= timedelta(seconds=1)
    ]
    assert sorted((r["step_1_id"], r["step_2_id"], r["step_3_id"]) for r in got) == sorted(want)
    assert want


@pytest.mark.parametrize("budget", [Budget(), Budget(4)])
def test_overlap_join(spark, budget):
    rows = random_events(4, n=200)
    df = frame(spark, rows)
    left, right = df.where("event_type = 'a'"), df.where("event_type = 'b'")
    got = joins.overlap_join(left, right, "8 seconds", "2 seconds", budget=budget).collect()
    hop = {r[0]: micros(r[1]) // 2_000_000 for r in rows}
    want = [
        (a[0], b[0])
        for a in rows for b in rows
        if a[3] == "a" and b[3] == "b" and abs(hop[a[0]] - hop[b[0]]) < 4
    ]
    assert sorted((r["left_event_id"], r["right_event_id"]) for r in got) == sorted(want)


def test_followed_within_is_the_fold(spark):
    rows = random_events(5, n=150, span=600)
    got = windows.followed_within(frame(spark, rows), "a", "b", "10 seconds", "5 seconds").collect()
    want = set()
    for w in range(micros(T0) // 5_000_000 - 2, micros(T0) // 5_000_000 + 130):
        state = 0
        for r in sorted(rows, key=lambda r: (r[1], r[0])):
            if w * 5_000_000 <= micros(r[1]) < w * 5_000_000 + 10_000_000:
                if state == 0 and r[3] == "a":
                    state = -1
                elif state == -1 and r[3] == "b":
                    state = 100
        if state > 0:
            want.add(w)
    assert {micros(r["window_start"]) // 5_000_000 for r in got} == want


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_salted_join(spark, how):
    rng = random.Random(6)
    left = [(i, 0 if rng.random() < 0.4 else rng.randrange(30)) for i in range(300)]
    right = [(k, k * 10) for k in range(0, 30, 2)]
    a = spark.createDataFrame(left, "id long, k long")
    b = spark.createDataFrame(right, "k long, v long")
    got = salted_join(a, b, ["k"], ["id"], how, Budget(10))
    assert got.columns == a.join(b, ["k"], how).columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, a.join(b, ["k"], how).collect()))


def haversine(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(h, 1.0)))


def test_one_key_of_nine_million_pairs_is_no_single_task(spark):
    left, right = (spark.range(3_000).selectExpr(f"id as {side}", "id div 100000 as k") for side in "ab")
    pairs = skew.tiled_join(left, right, ["k"], ["a"], ["b"]).select(F.spark_partition_id().alias("task"), "a", "b")
    each = [r["n"] for r in pairs.groupBy("task").agg(F.count("a").alias("n"), F.sum("b")).collect()]
    assert sum(each) == 9_000_000 and max(each) < 8_000_000


@pytest.mark.parametrize("radius_km", [1, 40, 300, 3000, 9000, 25000])
@pytest.mark.parametrize("budget", [Budget(), Budget(3)])
def test_pairs_within(spark, radius_km, budget):
    """Includes the poles, the 180th meridian, crowded spots and far-off places."""
    rng = random.Random(radius_km)
    spots = [(90.0, 0.0), (-90.0, 10.0), (89.9, 170.0), (89.9, -10.0), (0.0, 180.0), (0.0, -180.0), (0.1, -179.9)]
    spots += [(60.0, 179.99), (60.01, -179.99), (-89.99, 77.0)]
    spots += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(50)]
    spots += [(40 + rng.uniform(-0.5, 0.5), -105 + rng.uniform(-0.5, 0.5)) for _ in range(40)]
    points = list(enumerate(spots))
    df = spark.createDataFrame([(i, *p) for i, p in points], "user_id long, lat double, lon double")
    got = geo.pairs_within(df, f"{radius_km} km", budget=budget).collect()
    want = [(i, j) for i, p in points for j, q in points if haversine(p, q) <= radius_km * 1000]
    assert sorted((r["left_id"], r["right_id"]) for r in got) == sorted(want)


def test_pairs_within_of_repeated_and_unnamed_objects(spark):
    """Both ways, however often an id comes up or is missing; distances have the same bits both ways."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 2, 3, None]), 40 + rng.uniform(-0.1, 0.1), -105 + rng.uniform(-0.1, 0.1)) for _ in range(25)]
    df = spark.createDataFrame(rows, "user_id long, lat double, lon double")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for include_self in (True, False):
        got = geo.pairs_within(df, "10 km", include_self=include_self).collect()
        near = [(a[0], b[0]) for a in rows for b in rows if haversine(a[1:], b[1:]) <= 10_000]
        want = [p for p in near if include_self or None not in p and p[0] != p[1]]
        assert sorted(((r["left_id"], r["right_id"]) for r in got), key=key) == sorted(want, key=key)
        ways = [{r["distance_m"] for r in got if (r["left_id"], r["right_id"]) == p} for p in ((1, 3), (3, 1))]
        assert ways[0] == ways[1] != set()


@pytest.mark.parametrize("budget", [Budget(), Budget(4)])
def test_box_and_axis_pairs(spark, budget):
    rng = random.Random(8)
    rows = [
        (i, T0 + timedelta(seconds=rng.uniform(0, 60)), rng.randrange(4), rng.uniform(0, 3), rng.uniform(-2, 2))
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, lat double, lon double")
    hop = {r[0]: micros(r[1]) // 2_000_000 for r in rows}

    def alive(a, b):
        return a[2] != b[2] and abs(hop[a[0]] - hop[b[0]]) < 5

    box = geo.box_pairs(df, 0.7, 0.9, "10 seconds", "2 seconds", budget=budget).collect()
    want = [
        (a[0], b[0]) for a in rows for b in rows
        if alive(a, b) and abs(a[3] - b[3]) <= 0.7 and abs(a[4] - b[4]) <= 0.9
    ]
    assert sorted((r["left_event"], r["right_event"]) for r in box) == sorted(want)

    def axis(column, limit):
        return [
            (a[2], b[2], abs(a[column] - b[column]), max(hop[a[0]], hop[b[0]]), min(hop[a[0]], hop[b[0]]) + 5)
            for a in rows for b in rows
            if alive(a, b) and abs(a[column] - b[column]) <= limit
        ]

    pairs = geo.axis_pair_join(df, 0.7, 0.9, "10 seconds", "2 seconds", budget=budget).collect()
    joined = [
        (x[0], x[1], round(x[2], 9), round(y[2], 9), max(x[3], y[3]))
        for x in axis(3, 0.7) for y in axis(4, 0.9)
        if x[:2] == y[:2] and x[3] < y[4] and y[3] < x[4]
    ]
    got = [
        (r["left_id"], r["right_id"], round(r["lat_diff"], 9), round(r["lon_diff"], 9), micros(r["valid_from"]) // 2_000_000)
        for r in pairs
    ]
    assert sorted(got) == sorted(joined)


ARRIVALS = {
    "repeated": lambda rng, i: rng.randrange(100),
    "sparse": lambda rng, i: rng.randrange(-(1 << 62), 1 << 62),
    "one value": lambda rng, i: 7 if rng.random() < 0.7 else rng.randrange(20),
    "missing": lambda rng, i: None if rng.random() < 0.3 else i,
    "all missing": lambda rng, i: None,
}


@pytest.mark.parametrize("rows_per_range", [1, 7, 1_000_000])
@pytest.mark.parametrize("arrivals", ARRIVALS)
def test_late(spark, rows_per_range, arrivals):
    rng = random.Random(9)
    rows = [(i, ARRIVALS[arrivals](rng, i), T0 + timedelta(seconds=i + rng.randrange(6))) for i in range(200)]
    rows[5] = (5, rows[5][1], None)
    df = spark.createDataFrame(rows, "event_id long, arrival long, ts timestamp")
    flagged = liveness.flag_late(df, "arrival", budget=skew.Budget(rows=rows_per_range)).collect()
    want, top = set(), datetime.min
    for event_id, _, ts in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        if ts is not None and ts < top:
            want.add(event_id)
        top = max(top, ts or top)
    assert len(flagged) == len(rows) and {r["event_id"] for r in flagged if r["late"]} == want


@pytest.mark.parametrize("arrivals", ["repeated", "sparse", "one value"])
def test_ranges_follow_each_other_within_the_budget(spark, arrivals):
    rng = random.Random(12)
    rows = [(i, ARRIVALS[arrivals](rng, i)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "event_id long, arrival long")
    ranged = skew.in_ranges(df, "arrival", "event_id", skew.Budget(rows=50)).collect()
    by_range = {}
    for r in ranged:
        by_range.setdefault(tuple(r[c] for c in skew.RANGE), []).append((r["arrival"], r["event_id"]))
    in_order = [sorted(by_range[k]) for k in sorted(by_range)]
    assert [x for own in in_order for x in own] == sorted((a, i) for i, a in rows)
    assert max(map(len, in_order)) <= 150
    assert len(in_order) <= 4 * 2_000 / 50


def test_a_missing_arrival_makes_nothing_late(spark):
    rows = [(0, 1, 1), (1, 2, 2), (2, None, 9), (3, 4, 4)]
    df = spark.createDataFrame([(i, a, T0 + timedelta(seconds=t)) for i, a, t in rows], "event_id long, arrival long, ts timestamp")
    assert not any(r["late"] for r in liveness.flag_late(df, "arrival").collect())
    assert liveness.require_order(df, "arrival").count() == 4 and liveness.drop_late(df, "arrival").count() == 4


@pytest.mark.parametrize("budget", BUDGETS)
def test_transitions(spark, budget):
    rng = random.Random(10)
    rows = [(*r, rng.choice([0.0, 1.0]), 0.0) for r in random_events(11)]
    df = spark.createDataFrame(
        rows, "event_id long, ts timestamp, user_id long, event_type string, lat double, lon double"
    )
    fence = geo.Fence(0.0, 0.0, "1 km")
    got = geo.geofence_transitions(df, fence, budget=budget).collect()
    want, state = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        now = r[4] == 0.0
        if now != state.get(r[2], False):
            want.append((r[0], "enter" if now else "leave"))
        state[r[2]] = now
    assert sorted((r["event_id"], r["transition"]) for r in got) == sorted(want)


def test_hop_aggregate(spark):
    rows = random_events(12)
    got = windows.hop_aggregate(
        frame(spark, rows), ["event_type"], "15 seconds", "5 seconds", {"n": windows.count_rows()}
    ).collect()
    want = {}
    for r in rows:
        pane = micros(r[1]) // 5_000_000
        for w in range(pane - 2, pane + 1):
            want[r[3], w] = want.get((r[3], w), 0) + 1
    assert {(r["event_type"], micros(r["window_start"]) // 5_000_000): r["n"] for r in got} == want
    assert len(got) == len(want)


def test_hop_aggregate_of_any_size(spark):
    """A size that is no multiple of the slide."""
    rows = random_events(13)
    got = windows.hop_aggregate(
        frame(spark, rows), [], "7 seconds", "5 seconds", {"n": windows.count_rows()}
    ).collect()
    want = {}
    for r in rows:
        us = micros(r[1])
        for w in range(us // 5_000_000 - 1, us // 5_000_000 + 1):
            if w * 5_000_000 <= us < w * 5_000_000 + 7_000_000:
                want[w] = want.get(w, 0) + 1
    assert {micros(r["window_start"]) // 5_000_000: r["n"] for r in got} == want


@pytest.mark.parametrize(("size", "slide"), [(10, 2), (7, 3), (2, 5), (6, 6), (9, 4)])
@pytest.mark.parametrize("by_user", [False, True])
def test_windows_of_any_size(spark, size, slide, by_user):
    """Counts, smallest and largest over windows, also where the size is no multiple of the slide."""
    rows = [(*r[:3], r[3]) for r in random_events(31, n=120, span=300)]
    keys = ["user_id"] if by_user else []
    wanted = {
        "n": windows.count_rows(),
        "low": windows.smallest(F.when(F.col("event_type") == "a", F.col("event_id"))),
        "high": windows.largest(F.struct("event_type", "event_id")),
    }
    got = windows.hop_aggregate(frame(spark, rows), keys, f"{size} seconds", f"{slide} seconds", wanted).collect()
    want = {}
    for event_id, ts, user, kind in rows:
        second = micros(ts) // 1_000_000
        first = (second - size) // slide * slide
        for w in range(first, second + 1, slide):
            if w <= second and micros(ts) < (w + size) * 1_000_000 and w * 1_000_000 <= micros(ts):
                want.setdefault((user if by_user else None, w), []).append((event_id, kind))
    assert len(got) == len(want)
    for r in got:
        own = want[r["user_id"] if by_user else None, micros(r["window_start"]) // 1_000_000]
        assert micros(r["window_end"]) - micros(r["window_start"]) == size * 1_000_000
        assert r["n"] == len(own) and tuple(r["high"]) == max((k, i) for i, k in own)
        assert r["low"] == min((i for i, k in own if k == "a"), default=None)


def test_long_windows_with_a_short_slide_copy_nothing(spark):
    """A day by a second: what is moved follows the events, not the 86,400 windows over each."""
    rows = random_events(32, n=60, span=400)
    busy = windows.event_frequency(frame(spark, rows), "a", 12, "1 day", "1 second")
    made = busy.where("n >= 1000000")  # no window is listed
    assert made.count() == 0
    explained = busy._jdf.queryExecution().optimizedPlan().toString()
    above = explained.index("explode") if "explode" in explained else explained.index("Generate")
    assert "Filter" in explained[above:]  # the count is tested below the list of windows
    assert sum(r[3] == "a" for r in rows) >= 12 and busy.count() > 80_000


def near_product(rng, left, right, hot_left, hot_right):
    a = [(i, 0 if rng.random() < hot_left else rng.randrange(1, 40)) for i in range(left)]
    b = [(i, 0 if rng.random() < hot_right else rng.randrange(1, 40)) for i in range(right)]
    return a, b


@pytest.mark.parametrize(("hot_left", "hot_right"), [(0.6, 0.02), (0.02, 0.6), (0.5, 0.5), (0.0, 0.0)])
def test_tiles(spark, hot_left, hot_right):
    """A key hot on the looking side only, on the resting side only, or on both."""
    a, b = near_product(random.Random(7), 900, 700, hot_left, hot_right)
    left = spark.createDataFrame([*a, (-1, None)], "id long, k long")
    right = spark.createDataFrame([*b, (-1, None)], "other long, k long")
    budget = Budget(pairs=600)
    got = skew.tiled_join(left, right, ["k"], ["id"], ["other"], budget)
    assert got.columns == ["k", "id", "other"]
    want = sorted((k, i, j) for i, k in a for j, q in b if q == k)
    assert sorted(map(tuple, got.collect())) == want
    cut, across = skew.tiles(left, right, ["k"], ["id"], ["other"], budget)
    on = ["k", "_row", "_col"]
    sizes = cut.groupBy(on).agg(F.count("*").alias("l")).join(across.groupBy(on).agg(F.count("*").alias("r")), on)
    pairs = sorted(r["l"] * r["r"] for r in sizes.collect())
    assert pairs[-1] <= 4 * max(pairs[len(pairs) // 2], 600)
    # Each side is copied along its own axis only: far fewer rows than pairs.
    assert cut.count() + across.count() < len(want) / 4 + len(a) + len(b) + 2


def test_tiles_of_all_keys_are_bounded(spark, monkeypatch):
    """A budget far too small for all pairs does not copy rows more and more often."""
    monkeypatch.setattr(skew, "TILES", 40)
    left = spark.range(600).selectExpr("id", "id % 2 AS k")
    right = spark.range(400).selectExpr("id AS other", "id % 2 AS k")
    cut = []
    tiles = skew.tiles
    monkeypatch.setattr(skew, "tiles", lambda *args: cut.extend(tiles(*args)) or tuple(cut))
    got = skew.tiled_join(left, right, ["k"], ["id"], ["other"], Budget(pairs=1))
    assert got.count() == 2 * 300 * 200
    assert got.distinct().count() == 2 * 300 * 200
    assert cut[0].count() + cut[1].count() < 20 * 1_000


def test_axis_pairs_of_devices_with_many_live_positions(spark):
    """Each latitude pair of two devices meets each of their longitude pairs, if all four events are alive together."""
    rnd = random.Random(11)
    rows = [(i, i % 3, rnd.randrange(0, 120), rnd.randrange(0, 4) / 4, rnd.randrange(0, 4) / 4) for i in range(28)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long, lat double, lon double").withColumn("ts", F.timestamp_seconds("s"))
    got = geo.axis_pair_join(df, 0.25, 0.5, "60 seconds", "10 seconds")
    got = got.withColumns({c: F.unix_seconds(c) for c in ("valid_from", "valid_to")}).collect()
    want = []
    for a1, a2, b1, b2 in itertools.product(rows, repeat=4):
        if a1[1] == a2[1] != b1[1] == b2[1] and abs(a1[3] - b1[3]) <= 0.25 and abs(a2[4] - b2[4]) <= 0.5:
            hops = [e[2] // 10 for e in (a1, a2, b1, b2)]
            if max(hops) - min(hops) < 6:
                want.append((a1[1], b1[1], abs(a1[3] - b1[3]), abs(a2[4] - b2[4]), max(hops) * 10, min(hops) * 10 + 60))
    assert sorted(map(tuple, got)) == sorted(want)
