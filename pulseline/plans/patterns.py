"""Event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseline.operators import sequences
from pulseline.operators.filters import of_types
from pulseline.plans.registry import A, B, C, D, Query, hops
from pulseline.sources.tables import events

PATTERNS = [[A, B, C], [A, B, D], [A, C, D]]


def seq_fsm_hop(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.sequence_fsm(events(spark, folder), (A, B, C, D), "1 hour", "10 minutes")


def seq_abc_immediate(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.match_sequence(events(spark, folder), [A, B, C], "10 minutes")


def seq_abc_unbounded(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.match_sequence(events(spark, folder), [A, B, C], None)


def seq_a_bc_d_immediate(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.match_sequence(events(spark, folder), [A, [B, C], D], "10 minutes")


def seq_abc_per_user(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.match_sequence(events(spark, folder), [A, B, C], "24 hours", ("user_id",))


def seq_abcd_filtered(spark: SparkSession, folder: str) -> DataFrame:
    kept = of_types(events(spark, folder), A, B, C, D)
    return sequences.match_sequence(kept, [A, B, C, D], "1 hour")


def seq_last_seen(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.last_seen_order(events(spark, folder), PATTERNS)


def _consecutive(conditions: list[str], within: str | None, over: str = "", where: str = "TRUE") -> str:
    """SQL that reads the following events with lead, anchored at the first one."""
    key = f"PARTITION BY {over} " if over else ""
    reads = ", ".join(
        f"lead({c}, {j}) OVER w AS {n}{j}"
        for j in range(1, len(conditions))
        for c, n in (("event_id", "i"), ("ts", "t"), ("event_type", "k"))
    )
    names = ["event_type"] + [f"k{j}" for j in range(1, len(conditions))]
    times = ["ts"] + [f"t{j}" for j in range(1, len(conditions))]
    tests = [f"{n} IN ({c})" for n, c in zip(names, conditions)]
    if within:
        tests += [f"{y} - {x} <= INTERVAL '{within}'" for x, y in zip(times, times[1:])]
    ids = ["event_id"] + [f"i{j}" for j in range(1, len(conditions))]
    out = ", ".join(f"{i} AS step_{n}_id, {t} AS step_{n}_ts" for n, (i, t) in enumerate(zip(ids, times), 1))
    return (
        f"SELECT {over + ', ' if over else ''}{out} FROM (SELECT *, {reads} FROM events WHERE {where} "
        f"WINDOW w AS ({key}ORDER BY ts, event_id)) WHERE {' AND '.join(tests)}"
    )


_FSM = f"""WITH w AS (
    SELECT ws, ts, event_id, event_type AS k, lag(event_type, 1) OVER o AS p1, lag(event_type, 2) OVER o AS p2,
           lag(event_type, 3) OVER o AS p3
    FROM {hops("events", 10, 6)} WHERE event_type <> 'error' WINDOW o AS (PARTITION BY ws ORDER BY ts, event_id)),
  s AS (
    SELECT *, coalesce(p3 = 'view' AND p2 = 'click' AND p1 = 'purchase' AND k = 'signup', FALSE) AS full_run,
           coalesce(p2 = 'view' AND p1 = 'click' AND k = 'purchase', FALSE) AS short_run FROM w)
  SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, ts, event_id, CASE WHEN done THEN 4 ELSE 3 END AS state
  FROM (SELECT *, bool_or(full_run) OVER (PARTITION BY ws ORDER BY ts, event_id) AS done FROM s)
  WHERE done OR short_run"""


def _last_seen(pattern: list[str]) -> str:
    seen = [f"max(ts) FILTER (event_type = '{t}')" for t in pattern]
    order = " AND ".join(f"{x} <= {y}" for x, y in zip(seen, seen[1:]))
    return (
        f"SELECT user_id, '{','.join(pattern)}' AS pattern, {seen[0]} AS first_ts, {seen[-1]} AS last_ts "
        f"FROM events GROUP BY user_id HAVING {order}"
    )


QUERIES = {
    "seq_fsm_hop": Query(seq_fsm_hop, _FSM),
    "seq_abc_immediate": Query(
        seq_abc_immediate, _consecutive(["'view'", "'click'", "'purchase'"], "10 minutes")
    ),
    "seq_abc_unbounded": Query(
        seq_abc_unbounded, _consecutive(["'view'", "'click'", "'purchase'"], None)
    ),
    "seq_a_bc_d_immediate": Query(
        seq_a_bc_d_immediate, _consecutive(["'view'", "'click', 'purchase'", "'signup'"], "10 minutes")
    ),
    "seq_abc_per_user": Query(
        seq_abc_per_user, _consecutive(["'view'", "'click'", "'purchase'"], "24 hours", over="user_id")
    ),
    "seq_abcd_filtered": Query(
        seq_abcd_filtered,
        _consecutive(
            ["'view'", "'click'", "'purchase'", "'signup'"], "1 hour", where="event_type <> 'error'"
        ),
    ),
    "seq_last_seen": Query(seq_last_seen, " UNION ALL ".join(_last_seen(p) for p in PATTERNS)),
}
