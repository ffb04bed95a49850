"""Positions: latest fix, neighbours in a radius or a box, geofences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.functions.geo import EARTH_RADIUS_M, euclid, haversine_m, metres
from pulseline.functions.temporal import at, bin_of, duration, micros
from pulseline.operators.filters import latest
from pulseline.operators.joins import meet
from pulseline.operators.skew import DEFAULT, Budget, Within, tiled_join, with_previous
from pulseline.operators.windows import hop_aggregate, largest
from pulseline.sources.rules import Fence


def latest_location(df: DataFrame, device: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest position per device."""
    return latest(df, [device], [ts, "lat", "lon"], ts, tie)


def fence_distance(fence: Fence, lat: str = "lat", lon: str = "lon") -> Column:
    return haversine_m(F.col(lat), F.col(lon), F.lit(fence.latitude), F.lit(fence.longitude))


def within_radius(positions: DataFrame, fence: Fence) -> DataFrame:
    """Objects within a radius of a point, with their distance in metres."""
    near = positions.withColumn("distance_m", fence_distance(fence))
    return near.where(F.col("distance_m") <= metres(fence.radius))


def count_within(positions: DataFrame, fence: Fence) -> DataFrame:
    return within_radius(positions, fence).agg(F.count(F.lit(1)).alias("n"))


def inside(df: DataFrame, fence: Fence) -> DataFrame:
    """Flag each position as inside or outside of the fence."""
    return df.withColumn("inside", fence_distance(fence) <= metres(fence.radius))


def geofence_transitions(
    df: DataFrame,
    fence: Fence,
    device: str = "user_id",
    ts: str = "ts",
    tie: str = "event_id",
    budget: Budget = DEFAULT,
) -> DataFrame:
    """Fixes at which a device enters or leaves; before its first fix it counts as outside.

    A malformed fix (a NULL coordinate) says nothing and moves no device.
    """
    flagged = inside(df, fence).where(F.col("inside").isNotNull()).select(device, ts, tie, "inside")
    before = F.coalesce("prev_1.inside", F.lit(False))
    moved = with_previous(flagged, ["inside"], [device], 1, ts, tie, budget).where(
        F.col("inside") != before
    )
    kind = F.when(F.col("inside"), F.lit("enter")).otherwise(F.lit("leave"))
    return moved.select(device, ts, tie, kind.alias("transition"))


def _reach(lat: Column, angle: float) -> Column:
    """Largest difference in longitude, in degrees, of points within ``angle`` radians."""
    sideways = F.degrees(F.asin(F.least(F.lit(math.sin(angle)) / F.cos(F.radians(lat)), F.lit(1.0))))
    return F.when(F.abs(lat) + math.degrees(angle) < 90.0, sideways).otherwise(F.lit(180.0))


def pairs_within(
    positions: DataFrame,
    radius: str,
    device: str = "user_id",
    include_self: bool = True,
    budget: Budget = DEFAULT,
    digits: int | None = None,
) -> DataFrame:
    """Ordered pairs of objects within a radius of each other, with the distance in metres (rounded to ``digits`` if given).

    The sphere is cut into bands of latitude as high as the radius, each band into cells as wide
    as the radius reaches there. Every object looks into the cells its circle can touch in its own band and the one above, so the
    join is an equi join on (band, cell) and finds each pair once, those of one band both ways. Cells wrap around at
    180 degrees; a band near a pole is one cell.

    Of two objects one way is kept and measured, and given both ways. What a distance is made of is added to an object where it meets others. Whether it is near is told by the chord
    between points on the unit sphere, which takes no sines per pair; only where rounding could matter is it the distance.
    """
    limit = metres(radius)
    # Slightly wider than the radius, so that rounding cannot push a pair out of reach.
    angle = min(limit / EARTH_RADIUS_M * (1 + 1e-9) + 1e-12, math.pi)
    height = math.degrees(angle)

    def cells_in(band: Column) -> Column:
        edge = F.greatest(F.abs(band * height - 90.0), F.abs((band + 1) * height - 90.0))
        width = _reach(F.least(edge, F.lit(90.0)), angle)
        return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1))

    positions = positions.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    band = F.floor((F.col("lat") + 90.0) / height)
    turn = F.pmod(F.col("lon") + 180.0, F.lit(360.0))
    resting = positions.select(
        F.col(device).alias("right_id"),
        F.col("lat").alias("_rlat"),
        F.col("lon").alias("_rlon"),
        band.alias("_band"),
        turn.alias("_turn"),
    )
    count = cells_in(F.col("_band"))

    def point(side: str) -> dict[str, Column]:
        lat, lon = F.radians(f"_{side}lat"), F.radians(f"_{side}lon")
        return {f"_{side}cos": F.cos(lat), f"_{side}x": F.cos(lat) * F.cos(lon), f"_{side}y": F.cos(lat) * F.sin(lon), f"_{side}z": F.sin(lat)}

    resting = resting.withColumn(
        "_cell", F.least(F.floor(F.col("_turn") / (F.lit(360.0) / count)), count - 1)
    ).drop("_turn")

    looking = positions.select(
        F.col(device).alias("left_id"),
        F.col("lat").alias("_llat"),
        F.col("lon").alias("_llon"),
        turn.alias("_turn"),
        _reach(F.col("lat"), angle).alias("_reach"),
        band.alias("_home"),
        F.explode(F.array(band, band + 1)).alias("_band"),
    )
    width = F.lit(360.0) / count
    low = F.floor((F.col("_turn") - F.col("_reach")) / width)
    high = F.floor((F.col("_turn") + F.col("_reach")) / width)
    touched = F.array_distinct(F.transform(F.sequence(low, high), lambda c: F.pmod(c, count)))
    looking = looking.withColumn("_up", F.col("_band") != F.col("_home")).withColumn("_cell", F.explode(touched)).drop("_turn", "_reach", "_home")

    within = Within(lambda side: side.withColumns(point("l")), lambda side: side.withColumns(point("r")))
    near = tiled_join(looking, resting, ["_band", "_cell"], ["left_id"], ["right_id"], budget, within)
    # Inside a band pairs come up both ways, and one is kept. An object without an id is in no order, and keeps both.
    up, once = F.col("_up"), F.col("left_id") < F.col("right_id")
    if include_self:
        near = near.where(up | F.coalesce(F.col("left_id") <= F.col("right_id"), F.lit(True)))
    else:
        near = near.where(once | (up & (F.col("left_id") != F.col("right_id"))))
    distance = haversine_m(
        F.col("_llat"), F.col("_llon"), F.col("_rlat"), F.col("_rlon"), F.col("_lcos"), F.col("_rcos")
    )
    steps = [F.col(f"_l{axis}") - F.col(f"_r{axis}") for axis in "xyz"]
    chord = steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2]
    reach = 4 * math.sin(min(limit / EARTH_RADIUS_M, math.pi) / 2) ** 2
    sure = chord <= reach * (1 - 1e-9) - 1e-12
    near = near.where((chord <= reach * (1 + 1e-9) + 1e-12) & (sure | (distance <= limit)))
    measured = near.select("_up", "left_id", "right_id", (distance if digits is None else F.round(distance, digits)).alias("distance_m"))

    def way(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("left_id"), F.col(b).alias("right_id"), F.col("distance_m").alias("distance_m"))

    forth, back = way("left_id", "right_id"), way("right_id", "left_id")
    # No list is empty. "outer" keeps Spark from measuring once more, in the join, to see that.
    return measured.select(F.inline_outer(F.when(up | once, F.array(forth, back)).otherwise(F.array(forth))))


def _forward(dimensions: int) -> list[tuple[int, ...]]:
    """Half of the neighbour cells, and the cell itself: each cell pair comes up once."""
    offsets: list[tuple[int, ...]] = [()]
    for _ in range(dimensions):
        offsets = [(*o, step) for o in offsets for step in (-1, 0, 1)]
    return [o for o in offsets if o >= (0,) * dimensions]


def _alive(df: DataFrame, axes: list[str], size: str, hop: str, device: str, ts: str, tie: str) -> DataFrame:
    """Events as ``id``, ``tie``, ``ts``, the ``axes``, and the first and last hop (``low``, ``high``) of what they are made of."""
    size_us, hop_us = duration(size), duration(hop)
    if size_us % hop_us:
        raise ValueError("size must be a multiple of hop")
    at_hop = bin_of(F.col(ts), hop_us)
    return df.select(
        F.col(device).alias("id"), F.col(tie).alias("tie"), F.col(ts).alias("ts"), *axes, at_hop.alias("low"), at_hop.alias("high")
    )


def _close_pairs(
    alive: DataFrame, limits: dict[str, float], size: str, hop: str, budget: Budget, since: int | None = None
) -> DataFrame:
    """Pairs of rows of ``_alive`` of two devices, alive together and close on every axis; each pair both ways.

    A row is moved to its own bucket of time and the next, not to each cell around it: it looks into cells in the task that has
    the whole bucket, or a tile of it. With ``since`` only pairs with an event of that time (in microseconds) or later. A stream needs a watermark.
    """
    size_us, hop_us = duration(size), duration(hop)
    hops = size_us // hop_us
    axes = [f"_c_{axis}" for axis in limits]
    fields = ["id", "tie", "low", "high", "ts", *limits]
    forward = _forward(1 + len(limits))
    bucket = F.floor(F.col("low") / F.lit(hops))

    def cells(rows: DataFrame, prefix: str = "") -> DataFrame:
        return rows.withColumns({c: F.floor(F.col(f"{prefix}{axis}") / F.lit(limit)) for c, (axis, limit) in zip(axes, limits.items())})

    def steps(ahead: int) -> Column:
        """Steps to the cells that a row looks into, in its own bucket or in the next."""
        return F.array(*[F.struct(*[F.lit(s).alias(c) for c, s in zip(axes, o[1:])], F.lit(not any(o)).alias("own")) for o in forward if o[0] == ahead])

    def look(side: DataFrame) -> DataFrame:
        around = F.when(F.col("_ahead") == 0, steps(0)).otherwise(steps(1))
        out = cells(side, "l_").withColumn("_step", F.explode(around))
        return out.withColumns({**{c: F.col(c) + F.col(f"_step.{c}") for c in axes}, "_own": F.col("_step.own")}).drop("_step", "_ahead")

    def rest(side: DataFrame) -> DataFrame:
        return cells(side, "r_")

    resting = alive.select(*[F.col(c).alias(f"r_{c}") for c in fields], bucket.alias("_bucket"))
    both = F.explode(F.array(*[F.struct((bucket + i).alias("at"), F.lit(i).alias("ahead")) for i in (0, 1)]))
    looking = alive.select(*[F.col(c).alias(f"l_{c}") for c in fields], both.alias("_to"))
    looking = looking.withColumns({"_bucket": F.col("_to.at"), "_ahead": F.col("_to.ahead")}).drop("_to")
    # Alive together: from the first to the last hop of both it is less than a lifetime.
    first, last = F.least("l_low", "r_low"), F.greatest("l_high", "r_high")
    close = (F.col("l_id") != F.col("r_id")) & (last - first < hops)
    close = close & (~F.col("_own") | (F.col("l_id") < F.col("r_id")))
    for axis, limit in limits.items():
        close = close & (F.abs(F.col(f"l_{axis}") - F.col(f"r_{axis}")) <= limit)
    if since is not None:
        close = close & (micros(F.greatest("l_ts", "r_ts")) >= since)
    if alive.isStreaming:
        pairs = meet(look(looking), rest(resting), ["_bucket", *axes], "l_ts", "r_ts", size_us + hop_us)
    else:
        # Two cells of a and b rows have no more pairs than (a^2 + b^2) / 2, so squares of cells are counted, not neighbours.
        own, ahead = (float(sum(o[0] == i for o in forward)) for i in (0, 1))
        held = cells(alive).groupBy(bucket.alias("_at"), *axes).agg(F.count(F.lit(1)).alias("_n")).groupBy("_at")
        held = held.agg(F.sum("_n").alias("_n"), F.sum(F.col("_n").cast("double") * F.col("_n")).alias("_q"))
        none = F.lit(0).cast("bigint")
        here = F.struct(F.col("_at").alias("_bucket"), F.col("_n").alias("_l"), F.col("_n").alias("_r"), (F.col("_q") * (own + ahead / 2)).alias("_p"))
        after = F.struct((F.col("_at") + 1).alias("_bucket"), F.col("_n").alias("_l"), none.alias("_r"), (F.col("_q") * (ahead / 2)).alias("_p"))
        counts = held.select(F.inline_outer(F.array(here, after))).groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in ("_l", "_r", "_p")])
        within = Within(look, rest, tuple(axes), len(forward) // 2, counts.where(F.col("_r") > 0))
        pairs = tiled_join(looking, resting, ["_bucket"], ["l_tie"], ["r_tie"], budget, within)
    pairs = pairs.where(close)

    shared = [
        *[F.abs(F.col(f"l_{a}") - F.col(f"r_{a}")).alias(f"{a}_diff") for a in limits],
        at(last * hop_us).alias("valid_from"),
        at(first * hop_us + size_us).alias("valid_to"),
    ]

    def ends(a: str, b: str) -> Column:
        names = {"left_id": f"{a}_id", "right_id": f"{b}_id", "left_event": f"{a}_tie", "right_event": f"{b}_tie"}
        return F.struct(*[F.col(source).alias(name) for name, source in names.items()])

    return pairs.select(
        F.inline(F.array(ends("l", "r"), ends("r", "l"))),
        *shared,
    )


def box_pairs(
    df: DataFrame,
    lat_limit: float,
    lon_limit: float,
    size: str,
    hop: str,
    device: str = "user_id",
    ts: str = "ts",
    tie: str = "event_id",
    budget: Budget = DEFAULT,
    since: int | None = None,
) -> DataFrame:
    """Positions of two devices, alive together, close in latitude and in longitude.

    ``since`` leaves out pairs whose events both were before that time (in microseconds).
    """
    alive = _alive(df, ["lat", "lon"], size, hop, device, ts, tie)
    return _close_pairs(alive, {"lat": lat_limit, "lon": lon_limit}, size, hop, budget, since)


# Buckets of lifetimes by which a device's own events are moved together.
SPAN = 48


def axis_pair_join(
    df: DataFrame,
    lat_limit: float,
    lon_limit: float,
    size: str,
    hop: str,
    device: str = "user_id",
    ts: str = "ts",
    tie: str = "event_id",
    budget: Budget = DEFAULT,
) -> DataFrame:
    """Close latitudes and close longitudes, found apart and joined on the pair of devices.

    Unlike ``box_pairs`` it matches a latitude pair with every longitude pair of the same two
    devices alive at that time, so a device with several live positions multiplies rows.

    Four events meet only if any two of them do, also the two of one device. So each device's latitudes are
    first matched with its own longitudes alive at that time, mostly of the same event, and then positions
    of two devices: pairs close on one axis alone, far more than rows of the result, never come up.
    """
    hops = duration(size) // duration(hop)
    lats = _alive(df, ["lat"], size, hop, device, ts, tie)
    lons = _alive(df, ["lon"], size, hop, device, ts, tie).select("id", F.col("tie").alias("other"), "lon", F.col("low").alias("_hop"))

    def span(bucket: Column) -> Column:
        return F.floor(bucket / F.lit(SPAN))

    def look(side: DataFrame) -> DataFrame:
        home = F.floor(F.col("low") / F.lit(hops))
        here = F.greatest(home - 1, F.col("_span") * SPAN), F.least(home + 1, F.col("_span") * SPAN + (SPAN - 1))
        return side.withColumn("_bucket", F.explode(F.sequence(*here)))

    def rest(side: DataFrame) -> DataFrame:
        return side.withColumn("_bucket", F.floor(F.col("_hop") / F.lit(hops)))

    home = F.floor(F.col("low") / F.lit(hops))
    # A row is moved once, or twice where its buckets reach into the next span.
    looking = lats.withColumn("_span", F.explode(F.sequence(span(home - 1), span(home + 1))))
    resting = lons.withColumn("_span", span(F.floor(F.col("_hop") / F.lit(hops))))
    counts = resting.groupBy("id", "_span").agg(F.count(F.lit(1)).alias("_l"))
    counts = counts.withColumns({"_r": F.col("_l"), "_p": F.col("_l").cast("double") * F.col("_l")})
    both = tiled_join(looking, resting, ["id", "_span"], ["tie"], ["other"], budget, Within(look, rest, ("_bucket",), 2, counts))
    both = both.where(F.abs(F.col("low") - F.col("_hop")) < hops).withColumns(
        {"tie": F.xxhash64("tie", "other"), "low": F.least("low", "_hop"), "high": F.greatest("low", "_hop")}
    )
    near = _close_pairs(both, {"lat": lat_limit, "lon": lon_limit}, size, hop, budget)
    return near.select("left_id", "right_id", "lat_diff", "lon_diff", "valid_from", "valid_to")


def named_proximity(
    df: DataFrame,
    pairs: DataFrame,
    size: str,
    slide: str,
    within: float,
    device: str = "user_id",
    ts: str = "ts",
    tie: str = "event_id",
    budget: Budget = DEFAULT,
) -> DataFrame:
    """Watched pairs whose latest positions in a hopping window are close.

    ``pairs`` has ``left_id`` and ``right_id``. The distance is in coordinate units.
    """
    ends = pairs.select(
        "left_id",
        "right_id",
        F.posexplode(F.array("left_id", "right_id")).alias("_side", device),
    )
    # Each position goes to the pairs its device belongs to, so that one grouping finds the latest
    # of both sides: a maximum per side, which merges before the shuffle.
    fix = F.struct(ts, tie, "lat", "lon")
    both = hop_aggregate(
        df.join(ends, device) if df.isStreaming else tiled_join(df, ends, [device], [tie], ["left_id", "right_id"], budget),
        ["left_id", "right_id"],
        size,
        slide,
        {side: largest(F.when(F.col("_side") == i, fix)) for i, side in enumerate("ab")},
        ts=ts,
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    distance = euclid(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return (
        both.withColumn("distance", distance)
        .where(F.col("distance") <= within)
        .select("left_id", "right_id", "window_start", "window_end", "distance")
    )
