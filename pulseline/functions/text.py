"""Text handling: case-blind comparison, splitting and strict number parsing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def same_text(left: Column, right: Column | str) -> Column:
    """Case-insensitive equality."""
    other = F.lit(right.lower()) if isinstance(right, str) else F.lower(right)
    return F.lower(left) == other


def one_of(column: Column, values: Iterable[str]) -> Column:
    """Case-insensitive membership."""
    return F.lower(column).isin(*[v.lower() for v in values])


def words(column: Column) -> Column:
    """Split on runs of white space."""
    return F.split(column, r"\s+")


def blank_split(column: Column) -> Column:
    """Split on every single blank."""
    return F.split(column, " ")


def parse_long(column: Column) -> Column:
    """A whole number with an optional sign and nothing else around it; otherwise NULL."""
    return F.when(column.rlike(INTEGER), column.try_cast("bigint"))


def parse_double(column: Column) -> Column:
    """A decimal number and nothing else around it; otherwise NULL."""
    return F.when(column.rlike(DECIMAL), column.try_cast("double"))


def parse_fix(value: Column) -> Column:
    """``"<object> <lat> <lon>"`` as a struct; NULL when a part is missing or not a number."""
    parts = words(value)
    lat = parse_double(F.try_element_at(parts, F.lit(2)))
    lon = parse_double(F.try_element_at(parts, F.lit(3)))
    fix = F.struct(F.element_at(parts, 1).alias("object_id"), lat.alias("lat"), lon.alias("lon"))
    return F.when(lat.isNotNull() & lon.isNotNull(), fix)


def parse_location(value: Column) -> Column:
    """``"<lat> <lon> <accuracy>"`` as a struct; accuracy is a whole number from 0 to 255."""
    parts = blank_split(value)
    lat = parse_double(F.try_element_at(parts, F.lit(1)))
    lon = parse_double(F.try_element_at(parts, F.lit(2)))
    accuracy = parse_long(F.try_element_at(parts, F.lit(3)))
    location = F.struct(
        lat.alias("latitude"), lon.alias("longitude"), accuracy.try_cast("smallint").alias("accuracy")
    )
    return F.when(lat.isNotNull() & lon.isNotNull() & accuracy.between(0, 255), location)


def alert_line(template: str, *columns: Column) -> Column:
    """A printable alert in printf notation; keep the typed columns next to it."""
    return F.format_string(template, *columns)
