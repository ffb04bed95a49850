"""Sequences over slices: composed automata against the fold, and steps against the batch operators."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseline.operators import sequences
from pulseline.sources import slices
from pulseline.streaming import automata, stepwise
from pulseline.streaming.replay import run_to_end

T0 = datetime(2024, 1, 1)


@given(st.lists(st.integers(0, 3), max_size=30), st.integers(0, 30), st.sampled_from([(0, 1, 2, 3), (0, 0, 0, 1), (0, 1, 0, 1)]))
@settings(max_examples=200, deadline=None)
def test_pieces_compose(symbols, cut, pattern):
    """A stream in two pieces, each folded from every state, leads where the plain automaton leads."""
    pattern, n = np.array(pattern), len(pattern)
    plain, state, seen = [], 0, []
    for s in symbols:
        seen.append(s)
        if state < n:
            fits = [k for k in range(1, min(n, len(seen)) + 1) if seen[-k:] == list(pattern[:k])]
            state = max(fits, default=0)
        plain.append(state)
    x = np.array(symbols, dtype=np.int64)
    cut = min(cut, len(x))
    left = automata.states_after(x[:cut], 0, pattern)
    right = automata.states_after(x[cut:], int(left[-1]) if len(left) else 0, pattern)
    assert [*left.tolist(), *right.tolist()] == plain


@pytest.fixture()
def feed(spark, tmp_path):
    rng = random.Random(7)
    kinds = "abcd" * 3 + "e"
    rows, run = [], []
    for i in range(900):
        run = run or (list("abcd")[: rng.choice([2, 3, 4])] if rng.random() < 0.5 else [rng.choice(kinds)])
        kind = run.pop(0)
        t = T0 + timedelta(milliseconds=500 * (i // rng.choice([1, 1, 3])))
        rows.append((i, t, rng.choice([0, 0, 1, 2]), kind.upper() if rng.random() < 0.1 else kind))
    rng.shuffle(rows)
    path = str(tmp_path / "feed")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").repartition(
        3
    ).sortWithinPartitions("ts").write.option("parquet.block.size", 4096).parquet(path)
    return spark.read.parquet(path)


def stepped(spark, stored, tmp_path, step, carry, rows):
    stream = slices.slice_stream(spark, stored, str(tmp_path / "plan"), slice_rows=rows)
    stream = stream.withColumn("ts", stream["ts"].cast("timestamp"))
    run_to_end(stepwise.stepwise(stream, step, carry, str(tmp_path / "run"), str(tmp_path / "state")), in_slices=True)
    return stepwise.rows_of(spark, str(tmp_path / "run"))


def same(got, want):
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    left, right = (sorted(map(tuple, df.select(names).collect()), key=str) for df in (got, want))
    assert left == right and left


@pytest.mark.parametrize("rows", [130, 10_000])
@pytest.mark.parametrize("steps", [("a", "b", "c", "d"), ("a", "b", "a", "b")])
def test_state_machine_in_slices(spark, feed, tmp_path, rows, steps):
    got = stepped(spark, feed, tmp_path, automata.fsm_step(steps, "20 seconds", "5 seconds"), automata.FSM_CARRY, rows)
    stored = feed.withColumn("ts", feed["ts"].cast("timestamp"))
    same(got, sequences.sequence_fsm(stored, steps, "20 seconds", "5 seconds"))
    carried = sorted((tmp_path / "run" / "carry").iterdir())
    assert len(carried) <= 2
    # One state per open window: four windows hold an event, and one more may have begun.
    assert stepwise.carried(spark, str(tmp_path / "run"), int(carried[-1].name)).count() <= 5


@pytest.mark.parametrize("keys", [(), ("user_id",)])
def test_matches_in_slices(spark, feed, tmp_path, keys):
    steps = ["a", ["b", "c"], "c"]
    step, carry = automata.match_step(steps, "4 seconds", keys)
    got = stepped(spark, feed, tmp_path, step, carry, 130)
    stored = feed.withColumn("ts", feed["ts"].cast("timestamp"))
    same(got, sequences.match_sequence(stored, steps, "4 seconds", keys))
    newest = max((tmp_path / "run" / "carry").iterdir(), key=lambda p: int(p.name))
    assert stepwise.carried(spark, str(tmp_path / "run"), int(newest.name)).count() == (6 if keys else 2)


def test_a_batch_run_again_replaces_itself(spark, feed, tmp_path):
    step, carry = automata.match_step(["a", "b"], None)
    tries = []

    def fails_once(events, carried):
        rows, after = step(events, carried)
        tries.append(1)
        if len(tries) == 3:
            rows.write.mode("overwrite").parquet(str(tmp_path / "run" / "rows" / "batch=2"))
            raise RuntimeError("lost")
        return rows, after

    with pytest.raises(Exception):
        stepped(spark, feed, tmp_path, fails_once, carry, 130)
    got = stepped(spark, feed, tmp_path, fails_once, carry, 130)
    stored = feed.withColumn("ts", feed["ts"].cast("timestamp"))
    same(got, sequences.match_sequence(stored, ["a", "b"], None))
