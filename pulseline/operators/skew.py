"""Spreading hot keys.

A key may hold a large share of all rows. ``Budget.rows`` is what one task should get; a key
above it is hot. At most (row count / budget) keys can be hot. Spark measures the tables of hot
keys and broadcasts them if they are small; nothing forces it to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.functions.temporal import bin_of, duration, micros
from pulseline.session import joined_in_place


@dataclass(frozen=True)
class Budget:
    """Rows and pairs of rows one task should handle, and the time slices a hot key is first cut into."""

    rows: int = 2_000_000
    slice: str = "1 hour"
    pairs: int = 1_000_000


DEFAULT = Budget()


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    budget: Budget = DEFAULT,
) -> DataFrame:
    """Equi join whose hot keys are cut into several tasks.

    Left rows of a hot key are spread over salts by a hash of ``spread_by``; right rows of that
    key are copied to each of them. Other keys keep a single salt, and nothing is copied.
    """
    hot = (
        left.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > budget.rows)
        .select(*on, F.ceil(F.col("_n") / F.lit(budget.rows)).cast("int").alias("_salts"))
    )
    salts = F.coalesce("_salts", F.lit(1))
    spread = left.join(hot, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")
    )
    copied = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return spread.drop("_salts").join(copied.drop("_salts"), [*on, "_salt"], how).drop("_salt")


# Tiles of all keys together, at most; pairs and rows of one task of a join of pairs, and its tasks at most.
TILES, TASK_PAIRS, TASK_ROWS, TASKS = 2_000, 4_000_000, 500_000, 10_000


@dataclass(frozen=True)
class Within:
    """What becomes of the sides of a pair join in the task that gets them, after the shuffle.

    ``left`` and ``right`` add what the pairs need, and the ``keys`` that rows are matched on next to those they were
    moved by; a side may copy its rows there, about ``copies`` times, and nothing of it is moved or written.
    ``counts`` has the rows and (about) the pairs of each key they are moved by, as ``_pair_counts`` gives them.
    """

    left: Callable[[DataFrame], DataFrame]
    right: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...] = ()
    copies: int = 1
    counts: DataFrame | None = None


def _pair_counts(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of each key on the left and on the right, and their pairs: ``_l``, ``_r``, ``_p``; NULL for a key of one side alone."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*on).agg(F.count(F.lit(1)).alias(name))

    both = counted(left, "_l").join(counted(right, "_r"), on, "full")
    return both.withColumn("_p", F.col("_l").cast("double") * F.col("_r"))


def tiles(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_by: list[str],
    right_by: list[str],
    budget: Budget = DEFAULT,
    counts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi join with the tile of each row, ``_row`` and ``_col``, as further keys.

    What a key costs is the product of its rows on either side, or what ``counts`` says. A key with more pairs than the budget becomes a
    table of tiles of at most about so many: left rows are dealt to its rows by a hash of ``left_by`` and copied
    along the columns, right rows are dealt to its columns by ``right_by`` and copied along the rows. Its
    shape follows the two counts, so that the longer side is copied less. Other keys are one tile, and nothing is copied.

    Keys over the budget go to every task, so that no row is moved to learn its tiles: they are no more than all pairs
    have budgets, ``TILES`` at most in ``tiled_join``.
    """
    counts = _pair_counts(left, right, on) if counts is None else counts
    hot = counts.withColumn("_n", F.col("_p") / F.lit(budget.pairs)).where(F.col("_n") > 1)
    rows = F.least(F.greatest(F.ceil(F.sqrt(F.col("_n") * F.col("_l") / F.col("_r"))), F.lit(1)), F.ceil("_n"), F.col("_l"))
    hot = hot.withColumn("_rows", rows.cast("int")).withColumn("_cols", F.ceil(F.col("_n") / F.col("_rows")).cast("int"))
    hot = F.broadcast(hot.select(*on, "_rows", "_cols"))

    def dealt(side: DataFrame, by: list[str], own: str, other: str, place: str, copies: str) -> DataFrame:
        known = side.join(hot, on, "left").withColumns({own: F.coalesce(own, F.lit(1)), other: F.coalesce(other, F.lit(1))})
        placed = known.withColumn(place, F.pmod(F.xxhash64(*by), F.col(own)).cast("int"))
        return placed.withColumn(copies, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_rows", "_cols")

    return dealt(left, left_by, "_rows", "_cols", "_row", "_col"), dealt(right, right_by, "_cols", "_rows", "_col", "_row")


def tiled_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_by: list[str],
    right_by: list[str],
    budget: Budget = DEFAULT,
    within: Within | None = None,
) -> DataFrame:
    """Inner equi join whose hot keys, on either side or both, are cut into tiles of a bounded number of pairs.

    Pairs are counted first. All keys together get ``TILES`` tiles at most, so that rows are copied no more often the
    more pairs there are, and the join as many tasks as its pairs are worth. What is moved (and written to disk for it) is each
    row in as few columns as the pairs can be made from: ``within`` makes the rest where they meet. Neither side is
    broadcast: Spark reckons a side by the files it comes from, not by its rows after they were copied into cells or tiles.
    """
    counts = _pair_counts(left, right, on) if within is None or within.counts is None else within.counts
    rows = F.sum(F.coalesce("_l", F.lit(0)) + F.coalesce("_r", F.lit(0)))
    total, most, rows = (x or 0 for x in counts.agg(F.sum("_p"), F.max("_p"), rows).first())
    budget = replace(budget, pairs=max(budget.pairs, total / TILES))
    keys = list(on)
    if most > budget.pairs:
        left, right = tiles(left, right, on, left_by, right_by, budget, counts)
        keys += ["_row", "_col"]
    within = within or Within(lambda side: side, lambda side: side)
    tasks = 1 + int(total // max(TASK_PAIRS, budget.pairs / 2)) + int(rows * within.copies // TASK_ROWS)
    if within.keys:
        # One task would be no hash partitioning, and Spark would deal the rows again.
        joined_in_place(left.sparkSession)
        tasks = max(tasks, 2)
    left, right = (side.repartition(min(tasks, TASKS), *keys) for side in (left, right))
    return within.left(left).join(within.right(right).hint("merge"), [*keys, *within.keys]).drop("_row", "_col")


def attached(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``table``, which has a row per key at most; NULL keys match too.

    Spark broadcasts the table if it measures it as small.
    """
    named = table.select([F.col(c).alias(f"_of_{c}") if c in keys else F.col(c) for c in table.columns])
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(named[f"_of_{k}"])
    return rows.join(named, same, "left").drop(*[f"_of_{k}" for k in keys])


# Columns that number the ranges of ``in_ranges``, in their order; and the bins that ranges are first made of.
RANGE, BINS = ["_r0", "_r1", "_r2"], 1 << 16


def in_ranges(df: DataFrame, by: str, tie: str, budget: Budget = DEFAULT) -> DataFrame | None:
    """Add ``RANGE``: numbers of ranges that follow each other in the order of ``by`` and ``tie`` (numbers).

    None if all rows are within the budget of one range.

    Ranges come from the measured distribution. Bins of equal width are counted; neighbours with few rows share a range, and a
    bin over the budget is cut into as many parts as it has budgets of rows. What is over the budget even then is cut once
    more, by ``tie`` if it is a single value. Places are floating point, which keeps the order.
    """
    low, high, n = df.agg(F.min(by).cast("double"), F.max(by).cast("double"), F.count(F.lit(1))).first()
    if n <= budget.rows:
        return None
    low, width = low or 0.0, max(((high or 0.0) - (low or 0.0)) / BINS, 1.0)
    rows = df.withColumn("_at", (F.col(by).cast("double") - F.lit(low)) / F.lit(width)).withColumn("_bin", F.floor("_at"))
    parts = F.when(F.col("_n") > budget.rows, F.ceil(F.col("_n") / F.lit(budget.rows)))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    # At most BINS rows.
    bins = rows.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n")).select(
        "_bin",
        F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.lit(budget.rows)).alias("_r0"),
        parts.alias("_parts"),
    )
    inside = (F.col("_at") - F.col("_bin")) * F.col("_parts")
    # Bins of a range that are not cut come before the one that is.
    rows = rows.join(bins, "_bin").withColumns({"_r1": F.coalesce(F.floor(inside) + 1, F.lit(0)), "_at": inside - F.floor(inside)})
    crowded = rows.where(F.col("_r1") > 0).groupBy("_r0", "_r1").agg(
        F.count(F.lit(1)).alias("_n"),
        (F.min(by) == F.max(by)).alias("_single"),
        F.min(tie).cast("double").alias("_low"),
        (F.max(tie).cast("double") - F.min(tie).cast("double") + 1).alias("_span"),
    )
    crowded = crowded.where(F.col("_n") > budget.rows).withColumn("_parts2", F.ceil(F.col("_n") / F.lit(budget.rows)))
    share = F.when(F.col("_single"), (F.col(tie).cast("double") - F.col("_low")) / F.col("_span")).otherwise(F.col("_at"))
    cut = F.coalesce(F.floor(share * F.col("_parts2")) + 1, F.lit(0))
    out = rows.join(crowded.drop("_n"), ["_r0", "_r1"], "left").withColumn("_r2", cut)
    return out.select(*df.columns, *RANGE)


def _sliced(df: DataFrame, keys: list[str], ts: str, budget: Budget) -> DataFrame:
    """Add ``_hot`` and ``_s0`` .. ``_s2``: the time slice of each row of a hot key.

    Keys within the budget stay whole. A hot key is cut into slices of ``budget.slice``; a slice
    that is still over the budget is cut into as many equal parts as it has budgets of rows, and
    such a part once more, so that bursts are cut finely and quiet times are not. Slices follow
    each other in time; only events of one key at (nearly) the same microsecond never part.
    Without keys the whole input is one hot key.
    """
    width = duration(budget.slice)

    def over_budget(rows: DataFrame, path: list[str]) -> DataFrame:
        counted = rows.groupBy(*path).agg(F.count(F.lit(1)).alias("_n"))
        return counted.where(F.col("_n") > budget.rows)

    if keys:
        hot = over_budget(df, keys).select(*keys, F.lit(True).alias("_hot"))
        rows = attached(df, hot, keys).withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    else:
        rows = df.withColumn("_hot", F.lit(True))
    rows = rows.withColumns(
        {
            "_s0": F.when(F.col("_hot"), bin_of(F.col(ts), width)),
            # Place inside the slice, from 0 up to its width. Parts are scaled to that width too.
            "_at": F.pmod(micros(F.col(ts)), F.lit(width)),
        }
    )
    path, crowded = [*keys, "_s0"], F.col("_hot")
    for level in (1, 2):
        # Only rows of slices over the budget are counted again; mostly there are none.
        parts = F.ceil(F.col("_n") / F.lit(budget.rows)).cast("bigint").alias(f"_parts{level}")
        cut = over_budget(rows.where(crowded), path).select(*path, parts)
        scaled = F.col("_at") * F.col(f"_parts{level}")
        part = F.call_function("div", scaled, F.lit(width).cast("bigint"))
        rows = attached(rows, cut, path).withColumns(
            {f"_s{level}": part, "_at": F.pmod(scaled, F.lit(width))}
        )
        path, crowded = [*path, f"_s{level}"], F.col(f"_parts{level}").isNotNull()
    return rows.drop("_at", "_parts1", "_parts2")


def with_previous(
    df: DataFrame,
    fields: list[str],
    keys: list[str] | None = None,
    k: int = 1,
    ts: str = "ts",
    tie: str = "event_id",
    budget: Budget = DEFAULT,
) -> DataFrame:
    """Add ``prev_1`` .. ``prev_k``: structs of ``fields`` from the k rows before, in time order.

    The same as ``lag`` over (partition by keys order by ts, tie), but no task ever sorts a hot
    key as a whole. Inside a time slice an ordinary ``lag`` is right for all but the first k
    rows. Those are resolved over the seams: the first and last k rows of every slice, in which
    each first row finds its true predecessors. Keys are counted first; without a hot one, slices
    would cut nothing, and the plan is the ``lag`` alone.
    """
    keys = list(keys or [])
    slices = ["_s0", "_s1", "_s2"]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else df.agg(F.count(F.lit(1)).alias("_n"))
    any_hot = counted.where(F.col("_n") > budget.rows).limit(1).count() > 0

    def lags(window) -> dict[str, Column]:
        # Field by field, not as one struct: nothing is copied into the shuffle, and both branches
        # below can share it.
        out = {"_rank": F.row_number().over(window)}
        for j in range(1, k + 1):
            out.update({f"_lag_{j}_{f}": F.lag(f, j).over(window) for f in fields})
        return out

    def previous(rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if not c.startswith("_lag_") and c not in helpers]
        return rows.select(
            *kept,
            *[
                F.when(
                    F.col("_rank") > j, F.struct(*[F.col(f"_lag_{j}_{f}").alias(f) for f in fields])
                ).alias(f"prev_{j}")
                for j in range(1, k + 1)
            ],
        )

    helpers = {"_hot", "_rank", "_slice_rank", "_last", *slices}
    if not any_hot:
        return previous(df.withColumns(lags(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(ts, tie))))
    # _hot is part of the key only so that the seam branch can filter on it before its shuffle:
    # without hot keys that branch reads and moves nothing.
    in_slice = Window.partitionBy(*keys, "_hot", *slices).orderBy(ts, tie)
    local = _sliced(df, keys, ts, budget).withColumns(lags(in_slice))
    settled = previous(local.where(~F.col("_hot") | (F.col("_rank") > k)))
    # At most 2k rows per slice come here, so ordering them per key (without keys: in one task)
    # stays small however many rows the slices hold.
    along_key = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(ts, tie)
    edges = local.withColumn("_last", F.lead(F.lit(1), k).over(in_slice).isNull()).where(
        F.col("_hot") & ((F.col("_rank") <= k) | F.col("_last"))
    )
    seams = (
        edges.withColumn("_slice_rank", F.col("_rank"))
        .drop("_rank", *[f"_lag_{j}_{f}" for j in range(1, k + 1) for f in fields])
        .withColumns(lags(along_key))
        .where(F.col("_slice_rank") <= k)
    )
    return settled.unionByName(previous(seams))
