"""What Spark makes of the operators: no cross products, early filters, narrow reads."""

import io
import re
from contextlib import redirect_stdout

import pytest

from pulseline.plans.catalogue import QUERIES

BATCH = [n for n in QUERIES if not n.startswith("stream_")]


def plan(spark, folder, name):
    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES[name](spark, folder).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_product(spark, folder, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, folder, name))


@pytest.mark.parametrize("name", BATCH)
def test_no_python_in_batch(spark, folder, name):
    assert not re.search("ArrowEvalPython|BatchEvalPython|FlatMapGroups|MapInPandas", plan(spark, folder, name))


@pytest.mark.parametrize("name", ["avg_last_n", "last_n_above", "rule_table", "newest_per_series"])
def test_newest_rows_are_cut_before_the_shuffle(spark, folder, name):
    text = plan(spark, folder, name)
    tree = text[: text.index("\n\n")]
    assert tree.count("WindowGroupLimit") == 2
    below = tree[tree.index("Exchange") :]
    assert "WindowGroupLimit" in below


@pytest.mark.parametrize("name", ["avg_last_n", "freq_lookback", "overlap_join_ab", "seq_last_seen"])
def test_type_filter_reaches_the_scan(spark, folder, name):
    assert re.search(r"PushedFilters: \[[^\]]*event_type", plan(spark, folder, name))


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("freq_in_hop", {"ts", "event_type"}),
        ("a_then_b_in_hop", {"event_id", "ts", "event_type"}),
        ("device_liveness", {"event_id", "ts", "user_id"}),
        ("series_catalogue", {"user_id", "event_type"}),
        ("seq_last_seen", {"ts", "user_id", "event_type"}),
    ],
)
def test_scan_reads_only_what_is_needed(spark, folder, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>\n", plan(spark, folder, name))
    read = {part.split(":")[0] for schema in schemas for part in schema.split(",")}
    assert read == columns


@pytest.mark.parametrize("name", ["freq_in_hop", "a_then_b_in_hop", "inside_fence_hop", "snapshot_count"])
def test_rows_are_not_copied_into_windows(spark, folder, name):
    """Panes are aggregated before the shuffle, and only then spread over their windows."""
    text = plan(spark, folder, name)
    tree = text[: text.index("\n\n")]
    bottom_up = [line for line in reversed(tree.splitlines())]
    first_exchange = next(i for i, line in enumerate(bottom_up) if "Exchange" in line)
    below = "\n".join(bottom_up[:first_exchange])
    assert "Aggregate" in below and "Generate" not in below and "Expand" not in below


def test_retention_reaches_the_scan(spark, folder):
    """Row groups before the bound are not read."""
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,2024", plan(spark, folder, "retained_events"))


@pytest.mark.parametrize("name", ["overlap_join_tiled", "overlap_join_ab", "proximity_box", "radius_pairs", "proximity_named"])
def test_copied_rows_are_not_broadcast(spark, folder, name):
    """Spark reckons a side by its files, not by its copies in cells or tiles: it must not go through the driver."""
    text = plan(spark, folder, name)
    joins = [line for line in text[: text.index("\n\n")].splitlines() if "Join" in line]
    assert "SortMergeJoin" in joins[0]


def test_axis_pairs_are_not_joined_with_pairs(spark, folder):
    """Pairs close on one axis alone are never made: rows become pairs once, at the end."""
    assert plan(spark, folder, "axis_pair_join").count("inline(") == 1


@pytest.mark.parametrize("name", ["radius_pairs", "geo_report"])
def test_a_distance_is_measured_once(spark, folder, name):
    """The join tells near pairs without an arc; where rounding could matter, and for the result, it is taken once each."""
    plan_ = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString().split("list_in_radius")[0]
    join = next(line for line in plan_.splitlines() if "Join Inner" in line and "_lx" in line)
    assert "CASE WHEN" not in join[: join.index("_lx")] and "round(" not in join
    assert sum("round(" in line and "_llat" in line for line in plan_.splitlines()) == 1


@pytest.mark.parametrize("name", ["overlap_join_ab", "overlap_join_tiled"])
def test_times_of_pairs_are_made_per_event(spark, folder, name):
    """What a pair of lifetimes costs is compared, not made: times have their ends and their type before the join."""
    plan_ = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    above = plan_[: plan_.index("Join ")]
    assert "greatest(" in above and not re.search(r"cast\(|timestamp_micros", above)
