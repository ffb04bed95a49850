"""Avro records on the wire, in column expressions.

Records of whole numbers, floating point numbers, truth values and records of these have no lengths in
them: each number ends where its bytes say. So one pattern over the bytes as hexadecimal digits cuts a record into its
fields, and what does not fit it from the first byte to the last is malformed.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a framed value begins, before the four bytes of its schema's number.
MAGIC = "00"
ID_DIGITS = 8


def _varint(most: int) -> str:
    """Seven bits a byte, low ones first; the high bit says that more follow."""
    return rf"(?:[89A-F][0-9A-F]){{0,{most - 1}}}[0-7][0-9A-F]"


PATTERNS = {
    "int": _varint(5),
    "long": _varint(10),
    "float": "[0-9A-F]{8}",
    "double": "[0-9A-F]{16}",
    "boolean": "0[01]",
}
# Bits of a floating point number: all, exponent, fraction.
LAYOUT = {"float": (32, 8, 23), "double": (64, 11, 52)}


def _fields(schema: dict, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """(path, type) of the primitive fields of a record, in the order of the wire."""
    out = []
    for field in schema["fields"]:
        kind, here = field["type"], (*path, field["name"])
        if isinstance(kind, dict) and kind.get("type") == "record":
            out += _fields(kind, here)
        elif kind in PATTERNS:
            out.append((here, kind))
        else:
            raise ValueError(f"cannot read a field of type {kind!r}")
    return out


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value worked out once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _byte(digits: Column, i: Column) -> Column:
    return F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")


def _turned(digits: Column, size: int) -> Column:
    """The digits of ``size`` bits with their bytes in the other order."""
    return F.concat(*[F.substr(digits, F.lit(n + 1), F.lit(2)) for n in range(size // 4 - 2, -1, -2)])


def whole_from(digits: Column) -> Column:
    """A whole number from the digits of its zigzag varint."""
    count = F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1)
    part = lambda i: F.call_function("shiftleft", _byte(digits, i).bitwiseAND(F.lit(127)), (7 * i).cast("int"))
    raw = F.aggregate(count, F.lit(0).cast("bigint"), lambda total, i: total.bitwiseOR(part(i)))
    return _let(raw, lambda r: F.shiftrightunsigned(r, 1).bitwiseXOR(-r.bitwiseAND(F.lit(1))))


def real_from(digits: Column, kind: str) -> Column:
    """A floating point number from the digits of its little-endian bytes."""
    size, exponent_bits, fraction_bits = LAYOUT[kind]
    most, bias = (1 << exponent_bits) - 1, (1 << (exponent_bits - 1)) - 1

    def number(bits: Column) -> Column:
        fraction = bits.bitwiseAND(F.lit((1 << fraction_bits) - 1)).cast("double") / F.lit(float(1 << fraction_bits))
        sign = F.when(F.shiftrightunsigned(bits, size - 1).bitwiseAND(F.lit(1)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
        exponent = F.shiftrightunsigned(bits, fraction_bits).bitwiseAND(F.lit(most))

        def size_of(e: Column) -> Column:
            return (
                F.when(e == 0, fraction * F.lit(2.0 ** (1 - bias)))
                .when((e == most) & (fraction == 0), F.lit(float("inf")))
                .when(e == most, F.lit(float("nan")))
                .otherwise((fraction + 1) * F.pow(F.lit(2.0), e - bias))
            )

        return sign * _let(exponent, size_of)

    # Signed, as all 64 bits may be set.
    return _let(F.conv(_turned(digits, size), 16, -10).cast("bigint"), number).cast(kind)


def _value(digits: Column, kind: str) -> Column:
    if kind == "boolean":
        return digits == "01"
    if kind in LAYOUT:
        return real_from(digits, kind)
    # A whole number that does not fit its type is malformed.
    return whole_from(digits).try_cast("int") if kind == "int" else whole_from(digits)


def cut(value: Column, schema: str) -> Column:
    """The digits of each primitive field of a framed record (binary), as an array; NULL if it is malformed."""
    fields = _fields(json.loads(schema))
    pattern = f"^{MAGIC}([0-9A-F]{{{ID_DIGITS}}})" + "".join(f"({PATTERNS[kind]})" for _, kind in fields) + "$"
    marked = F.regexp_replace(F.hex(value), pattern, ",".join(f"${n}" for n in range(1, len(fields) + 2)))
    return _let(F.split(marked, ","), lambda parts: F.when(F.size(parts) == len(fields) + 1, parts))


def record(parts: Column, schema: str) -> Column:
    """The record, nested as the schema has it, from what ``cut`` gives."""
    flat = {path: _value(F.get(parts, F.lit(n)), kind) for n, (path, kind) in enumerate(_fields(json.loads(schema)), 1)}

    def nested(layer: dict, path: tuple[str, ...] = ()) -> Column:
        columns = []
        for field in layer["fields"]:
            here = (*path, field["name"])
            own = flat[here] if here in flat else nested(field["type"], here)
            columns.append(own.alias(field["name"]))
        return F.struct(*columns)

    return F.when(parts.isNotNull(), nested(json.loads(schema)))


def _hex_byte(number: Column) -> Column:
    return F.lpad(F.hex(number), 2, "0")


def _written_whole(number: Column, most: int) -> Column:
    def digits(raw: Column) -> Column:
        out = []
        for i in range(most):
            rest = F.shiftrightunsigned(raw, 7 * i)
            more = F.shiftrightunsigned(raw, 7 * (i + 1)) != 0 if i + 1 < most else F.lit(False)
            byte = rest.bitwiseAND(F.lit(127)) + F.when(more, F.lit(128)).otherwise(F.lit(0))
            out.append(F.when((rest != 0) | F.lit(i == 0), _hex_byte(byte)).otherwise(F.lit("")))
        return F.concat(*out)

    wide = number.cast("bigint")
    return F.when(number.isNotNull(), _let(F.shiftleft(wide, 1).bitwiseXOR(F.shiftright(wide, 63)), digits))


def _written_real(number: Column, kind: str) -> Column:
    """A NaN is written as the usual one, a negative zero as zero."""
    size, exponent_bits, fraction_bits = LAYOUT[kind]
    most, bias = (1 << exponent_bits) - 1, (1 << (exponent_bits - 1)) - 1
    special = F.lit(most << fraction_bits).cast("bigint")

    def bits_of(wide: Column) -> Column:
        def corrected(guess: Column) -> Column:
            """The logarithm may be off by one next to a power of two."""
            off = lambda up: F.when(up >= 2, guess + 1).when(up < 1, guess - 1).otherwise(guess)
            return F.greatest(_let(wide / F.pow(F.lit(2.0), guess), off), F.lit(1 - bias))

        def finite(power: Column) -> Column:
            def joined(scaled: Column) -> Column:
                fraction = F.when(scaled >= 1, scaled - 1).otherwise(scaled) * F.lit(float(1 << fraction_bits))
                exponent = F.when(scaled >= 1, power + bias).otherwise(F.lit(0)).cast("bigint")
                return F.shiftleft(exponent, fraction_bits).bitwiseOR(fraction.cast("bigint"))

            return _let(wide / F.pow(F.lit(2.0), power), joined)

        return (
            F.when(F.isnan(wide), special + F.lit(1 << (fraction_bits - 1)).cast("bigint"))
            .when(wide == float("inf"), special)
            .when(wide == 0, F.lit(0).cast("bigint"))
            .otherwise(_let(_let(F.floor(F.log2(wide)), corrected), finite))
        )

    sign = F.when((number < 0) & ~F.isnan(number), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    bits = _let(F.abs(number.cast(kind).cast("double")), bits_of).bitwiseOR(F.shiftleft(sign, size - 1))
    digits = _let(F.lpad(F.hex(bits), size // 4, "0"), lambda d: _turned(d, size))
    return F.when(number.isNotNull(), digits)


def encoded(value: Column, schema: str, schema_id: int = 1) -> Column:
    """A struct as a framed record (binary); NULL if a field is."""
    written = []
    for path, kind in _fields(json.loads(schema)):
        field = reduce(lambda c, name: c.getField(name), path, value)
        if kind == "boolean":
            written.append(F.when(field, F.lit("01")).when(~field, F.lit("00")))
        elif kind in LAYOUT:
            written.append(_written_real(field, kind))
        else:
            written.append(_written_whole(field, 5 if kind == "int" else 10))
    return F.unhex(F.concat(F.lit(MAGIC + f"{schema_id:0{ID_DIGITS}X}"), *written))
