"""Distances and length units."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseline.functions.text import parse_double, words

# Sphere radius in metres, and metres per length unit.
EARTH_RADIUS_M = 6372797.560856
UNIT_METRES = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}


def metres(text: str) -> float:
    """Metres of a length such as ``"9000 ft"``."""
    number, unit = text.split()
    return float(number) * UNIT_METRES[unit.lower()]


def metres_of(column: Column) -> Column:
    """Same on a text column; NULL for an unknown unit or a bad number."""
    parts = words(F.trim(column))
    unit = F.lower(F.try_element_at(parts, F.lit(2)))
    factor = F.lit(None).cast("double")
    for name, value in UNIT_METRES.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return parse_double(F.try_element_at(parts, F.lit(1))) * factor


def haversine_m(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos1: Column | None = None, cos2: Column | None = None
) -> Column:
    """Great-circle distance in metres; NULL if a coordinate is. The cosines of the latitudes may be given."""
    cos1 = F.cos(F.radians(lat1)) if cos1 is None else cos1
    cos2 = F.cos(F.radians(lat2)) if cos2 is None else cos2
    dlat = F.sin(F.radians(lat1 - lat2) / 2)
    dlon = F.sin(F.radians(lon1 - lon2) / 2)
    h = dlat * dlat + cos1 * cos2 * dlon * dlon
    # ``least`` would pass over a NULL.
    return F.asin(F.sqrt(F.when(h > 1.0, F.lit(1.0)).otherwise(h))) * (2 * EARTH_RADIUS_M)


def euclid(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight-line distance in coordinate units."""
    return F.sqrt(F.pow(lat1 - lat2, F.lit(2.0)) + F.pow(lon1 - lon2, F.lit(2.0)))


def degrees_of(distance_m: float) -> float:
    """Degrees of latitude spanned by a distance."""
    return math.degrees(distance_m / EARTH_RADIUS_M)
