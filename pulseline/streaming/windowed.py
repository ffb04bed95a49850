"""Streaming operators made of windowed aggregates alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.functions.temporal import bin_of, duration, interval, micros
from pulseline.operators.sequences import Steps, all_of, step_types


def stream_liveness(
    df: DataFrame, over: str = "181 seconds", fail: str = "242 seconds", device: str = "user_id"
) -> DataFrame:
    """``OVER`` and ``FAIL`` of silent devices: each is the end of a session with that gap.

    A state comes out as soon as the watermark shows that the silence lasted long enough.
    """

    def silences(status: str, gap: str) -> DataFrame:
        session = F.session_window("ts", f"{duration(gap)} microseconds")
        ended = df.groupBy(device, session.alias("session")).agg(F.max("ts").alias("last_seen"))
        return ended.select(
            device, "last_seen", F.lit(status).alias("status"), F.col("session.end").alias("since")
        )

    return silences("OVER", over).unionByName(silences("FAIL", fail))


def stream_match_sequence(
    df: DataFrame,
    steps: Steps,
    within: str,
    partition_by: tuple[str, ...] = (),
    bin_width: str = "1 second",
) -> DataFrame:
    """Strictly consecutive events of the given types over a stream, at most ``within`` apart.

    Order is kept in two levels, so that no task holds more than one short bin of raw events.
    Matches inside a bin are found there. For matches across bins only the first and last
    (steps - 1) events of each bin are needed; they are gathered over overlapping windows long
    enough for any match, and the window in whose first part a match starts reports it.
    """
    wanted = step_types(steps)
    count = len(wanted)
    bound, bin_us = duration(within), duration(bin_width)
    reach = bound * (count - 1)
    # A window owns the matches that start in its first slide; it must see a match to its end.
    slide = -(-max(reach, bin_us) // bin_us) * bin_us
    size = -(-(slide + reach + bin_us) // slide) * slide

    def matches(events: Column) -> Column:
        """Runs of consecutive elements that satisfy all steps, as an array of arrays."""

        def fits(run: Column) -> Column:
            at = [F.element_at(run, i + 1) for i in range(count)]
            kinds = [a["event_type"].isin(types) for a, types in zip(at, wanted)]
            gaps = [micros(b["ts"]) - micros(a["ts"]) <= bound for a, b in zip(at, at[1:])]
            return all_of([*kinds, *gaps])

        starts = F.when(F.size(events) >= count, F.sequence(F.lit(1), F.size(events) - (count - 1)))
        runs = F.transform(
            F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.slice(events, i, count)
        )
        return F.filter(runs, fits)

    def columns(run: Column) -> list[Column]:
        out = []
        for i in range(1, count + 1):
            out += [
                F.element_at(run, i)["event_id"].alias(f"step_{i}_id"),
                F.element_at(run, i)["ts"].alias(f"step_{i}_ts"),
            ]
        return out

    event = F.struct("ts", "event_id", "event_type")
    binned = df.groupBy(*partition_by, F.window("ts", f"{bin_us} microseconds").alias("bin")).agg(
        F.sort_array(F.collect_list(event)).alias("events")
    )
    in_bin = binned.select(*partition_by, F.explode(matches(F.col("events"))).alias("run"))

    edge = count - 1
    ends = F.when(
        F.size("events") > 2 * edge,
        F.concat(F.slice("events", 1, edge), F.slice("events", -edge, edge)),
    ).otherwise(F.col("events"))
    # The edges of one bin never make up a run together with another bin across the gap between
    # them: such a run would be longer than the pattern.
    owners = F.window(F.window_time("bin"), f"{size} microseconds", f"{slide} microseconds")
    seams = binned.select(*partition_by, "bin", ends.alias("ends")).groupBy(
        *partition_by, owners.alias("owner")
    ).agg(F.sort_array(F.flatten(F.collect_list("ends"))).alias("events"))
    first_ts = F.element_at("run", 1)["ts"]
    across = (
        seams.select(*partition_by, "owner", F.explode(matches(F.col("events"))).alias("run"))
        .where(bin_of(first_ts, bin_us) < bin_of(F.element_at("run", count)["ts"], bin_us))
        .where(
            (first_ts >= F.col("owner.start"))
            & (first_ts < F.col("owner.start") + interval(f"{slide} microseconds"))
        )
    )
    return in_bin.select(*partition_by, *columns(F.col("run"))).unionByName(
        across.select(*partition_by, *columns(F.col("run")))
    )


def stream_sequence_fsm(
    df: DataFrame, steps: tuple[str, str, str, str], size: str, slide: str
) -> DataFrame:
    """Progress of A, B, C, D in each hopping window, when the window closes.

    Rows as from ``sequences.sequence_fsm``. A window's events of the four types are one array, so
    windows should be as short as the runs looked for.
    """
    a, b, c, d = [s.lower() for s in steps]
    kind = F.lower("event_type")
    windows = F.window("ts", f"{duration(size)} microseconds", f"{duration(slide)} microseconds")
    event = F.struct("ts", "event_id", kind.alias("kind"))
    gathered = (
        df.where(kind.isin(a, b, c, d))
        .groupBy(windows.alias("window"))
        .agg(F.sort_array(F.collect_list(event)).alias("events"))
    )

    def ends_run(x: Column, i: Column, run: tuple[str, ...]) -> Column:
        back = len(run) - 1
        before = [
            F.element_at("events", (i - back + 1 + n).cast("int"))["kind"] == t
            for n, t in enumerate(run[:-1])
        ]
        return F.when(i >= back, all_of([*before, x["kind"] == run[-1]])).otherwise(F.lit(False))

    marked = F.transform(
        "events",
        lambda x, i: F.struct(
            x["ts"].alias("ts"),
            x["event_id"].alias("event_id"),
            ends_run(x, i, (a, b, c)).alias("short"),
            ends_run(x, i, (a, b, c, d)).alias("full"),
        ),
    )
    done = F.element_at(F.filter("marked", lambda m: m["full"]), 1)

    def place(m: Column) -> Column:
        return F.struct(m["ts"], m["event_id"])

    hits = (
        gathered.select("window", marked.alias("marked"))
        .select("window", "marked", F.when(F.exists("marked", lambda m: m["full"]), place(done)).alias("done"))
        .select(
            "window",
            "done",
            F.explode(
                F.filter("marked", lambda m: m["short"] | F.coalesce(place(m) >= F.col("done"), F.lit(False)))
            ).alias("m"),
        )
    )
    late = F.coalesce(place(F.col("m")) >= F.col("done"), F.lit(False))
    return hits.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "m.ts",
        "m.event_id",
        F.when(late, F.lit(4)).otherwise(F.lit(3)).alias("state"),
    )


def stream_distinct(df: DataFrame, keys: list[str]) -> DataFrame:
    """First arrival per key; state is kept as long as the watermark delay."""
    return df.dropDuplicatesWithinWatermark(keys)
