"""What joins of pairs move between tasks, and so write to disk: few copies of narrow rows."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from pulseline.operators import skew
from pulseline.operators.skew import Budget
from pulseline.plans import streams
from pulseline.plans.catalogue import QUERIES


def tree(spark, folder, name):
    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES[name](spark, folder).explain("formatted")
    return out.getvalue().split("\n\n")[0]


def moved(spark, folder, name):
    """The optimized plan from the first shuffle of the pair join down."""
    text = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    return text[text.index("RepartitionByExpression") :]


def test_tiles_of_many_pairs_are_few(spark):
    """Nine million pairs of one key with a budget of one pair."""
    left, right = (spark.range(3_000).selectExpr(f"id as {side}", "0 as k") for side in "ab")
    cut, tiles = [], skew.tiles
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(skew, "tiles", lambda *args: cut.extend(tiles(*args)) or tuple(cut))
        pairs = skew.tiled_join(left, right, ["k"], ["a"], ["b"], Budget(pairs=1))
    assert pairs.agg(F.count("a"), F.count_distinct("a", "b")).first() == (9_000_000, 9_000_000)
    assert cut[0].count() + cut[1].count() < 400_000


def test_rows_are_not_moved_to_learn_their_tiles(spark):
    """A sort-merge join with the table of hot keys would move every row once more than the join of pairs does."""
    left, right = (spark.range(3_000).selectExpr(f"id as {side}", "id % 7 as k") for side in "ab")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for side in skew.tiles(left, right, ["k"], ["a"], ["b"], Budget(pairs=600)):
            plan = side._jdf.queryExecution().executedPlan().toString()
            assert plan.index("Join") == plan.index("BroadcastHashJoin") + len("BroadcastHash")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("name", ["overlap_join_ab", "overlap_join_tiled"])
def test_ends_of_lifetimes_are_not_moved(spark, folder, name):
    assert "left_from" not in moved(spark, folder, name)


@pytest.mark.parametrize("name", ["radius_pairs", "geo_report"])
def test_points_on_the_sphere_are_not_moved(spark, folder, name):
    below = moved(spark, folder, name)
    assert "_lx" not in below and "_llat" in below


@pytest.mark.parametrize(("name", "joins"), [("proximity_box", 1), ("axis_pair_join", 3)])
def test_rows_are_copied_into_cells_where_they_meet(spark, folder, name, joins):
    """Each side is moved once per join, and copied above that shuffle, not below it."""
    text = tree(spark, folder, name)
    pieces = text.split("SortMergeJoin")[1:]
    assert len(pieces) == joins and all("Generate" in p[: p.index("Exchange")] for p in pieces)
    assert len(re.findall(r"Exchange", text)) == 2 * joins


@pytest.mark.parametrize(
    ("name", "columns"),
    [("overlap_join_ab", ["event_id", "ts", "event_type"]), ("proximity_box", ["event_id", "user_id", "ts", "lat", "lon"])],
)
def test_a_slice_is_held_without_what_pairs_do_not_need(spark, folder, monkeypatch, name, columns):
    class Seen(Exception):
        pass

    def spy(stream, *rest):
        raise Seen(stream.columns)

    monkeypatch.setattr(streams.stepwise, "stepwise", spy)
    with pytest.raises(Seen) as seen:
        QUERIES[f"stream_{name}"](spark, folder)
    assert seen.value.args[0] == columns
