"""Avro on the wire, against bytes written by hand and by plain Python."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from pulseline.functions import avro
from pulseline.sources import feeds

SCHEMA = json.dumps(
    {
        "type": "record",
        "name": "R",
        "fields": [
            {"name": "i", "type": "int"},
            {"name": "n", "type": {"type": "record", "name": "N", "fields": [{"name": "l", "type": "long"}, {"name": "f", "type": "float"}]}},
            {"name": "d", "type": "double"},
            {"name": "b", "type": "boolean"},
        ],
    }
)


def varint(n):
    n, out = (n << 1) ^ (n >> 63), []
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def plain(i, long, f, d, b):
    return b"\x00" + struct.pack(">I", 7) + varint(i) + varint(long) + struct.pack("<f", f) + struct.pack("<d", d) + bytes([b])


def rows():
    rng = random.Random(5)
    single = lambda x: struct.unpack("<f", struct.pack("<f", x))[0]
    edges = [0, 1, -1, 63, 64, -64, -65, 2**31 - 1, -(2**31)]
    reals = [0.0, 1.0, -1.0, 2.0, 0.1, 1e-40, 3.4028234663852886e38, math.inf, -math.inf, 1.1754943508222875e-38, 5e-324, 1.7976931348623157e308]
    out = [(i, e, single(f) if abs(f) < 3.5e38 or math.isinf(f) else 1.5, f, k % 2 == 0) for k, (i, e, f) in enumerate(
        zip([*edges, 5, 6, 7], [*edges[:7], 2**63 - 1, -(2**63), 8191, 8192, -8193], reals))]
    for _ in range(60):
        f = single(rng.uniform(-1, 1) * 10.0 ** rng.randrange(-37, 38))
        d = rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300)
        out.append((rng.randrange(-(2**31), 2**31), rng.randrange(-(2**63), 2**63) >> rng.randrange(60), f, d, rng.random() < 0.5))
    return out


def decoded(spark, values):
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in enumerate(values)], "k int, value binary")
    parts = df.select("k", avro.cut(F.col("value"), SCHEMA).alias("p"))
    return [r["e"] for r in parts.select("k", avro.record(F.col("p"), SCHEMA).alias("e")).orderBy("k").collect()]


def test_bytes_of_plain_python_are_read(spark):
    for got, (i, n, f, d, b) in zip(decoded(spark, [plain(*r) for r in rows()]), rows()):
        assert (got["i"], got["n"]["l"], got["n"]["f"], got["d"], got["b"]) == (i, n, f, d, b)
    (got,) = decoded(spark, [plain(1, 1, math.nan, math.nan, True)])
    assert math.isnan(got["n"]["f"]) and math.isnan(got["d"])


def test_written_bytes_are_those_of_plain_python(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows())], "k int, i int, l long, f float, d double, b boolean")
    value = F.struct("i", F.struct("l", "f").alias("n"), "d", "b")
    got = df.select("k", avro.encoded(value, SCHEMA, 7).alias("v")).orderBy("k").collect()
    assert [bytes(r["v"]) for r in got] == [plain(*r) for r in rows()]
    assert df.limit(1).select(avro.encoded(F.struct(F.lit(None).cast("int").alias("i"), F.struct("l", "f").alias("n"), "d", "b"), SCHEMA)).first()[0] is None


def test_malformed_bytes_become_null(spark):
    good = plain(1, 2, 1.5, 2.5, True)
    bad = [None, b"", good[:-1], good + b"\x00", b"\x01" + good[1:], good[:-1] + b"\x02", good[:5] + b"\xff" * 6 + good[6:], good]
    got = decoded(spark, bad)
    assert got[:-1] == [None] * 7 and got[-1]["i"] == 1
    # Five bytes may hold more than an int has room for.
    (wide,) = decoded(spark, [good[:5] + b"\xff\xff\xff\xff\x7f" + good[6:]])
    assert wide["i"] is None


def test_an_event_as_the_feed_brings_it(spark):
    """Golden bytes: device 5, one second after 1970, type 3, at 1.0, -2.0, accuracy -1."""
    raw = bytes.fromhex("00" "00000001" "0a" "02" "06" "0000803f" "000000c0" "01")
    df = spark.createDataFrame([(bytearray(raw),), (bytearray(b"x"),)], "value binary")
    good, bad = feeds.decode_avro(df).collect()
    assert (good["device_id"], good["event_type"], good["latitude"], good["longitude"], good["accuracy"]) == (5, 3, 1.0, -2.0, -1)
    assert bad["device_id"] is None and bad["ts"] is None


def test_fields_with_lengths_are_refused():
    with pytest.raises(ValueError):
        avro.cut(F.lit(None), json.dumps({"type": "record", "name": "r", "fields": [{"name": "s", "type": "string"}]}))
