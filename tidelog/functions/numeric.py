"""Numeric columns: the normal tail, bit tricks, sizes and order-preserving codes."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4, "p": 5}


def normal_tail(x: Column) -> Column:
    """Chance that a standard normal value exceeds x, within 1e-7 relative over the whole
    range, in built-in functions (a rational fit of the scaled complementary error
    function, whose coefficients are the published ones of Numerical Recipes' erfcc)."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    half = t * F.exp(-z * z + poly) / 2
    return F.when(x >= 0, half).otherwise(1 - half)


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def log2_floor(x: Column) -> Column:
    """Place of the highest set bit of a positive long."""
    return F.length(F.bin(x)) - 1


def rotate_right(x: Column, n: int) -> Column:
    n %= 64
    return x if n == 0 else F.shiftrightunsigned(x, n).bitwiseOR(F.shiftleft(x, 64 - n))


def parse_size(text: Column) -> Column:
    """Bytes of "4k", "8MB" or "1GiB" (base 1024, either case); anything else, blanks and a
    unit of bytes alone included, is an error, and so is a number beyond a long."""
    form = r"(?i)^([0-9]+)(?:([kmgtp])i?b?)?$"
    number, unit = F.regexp_extract(text, form, 1), F.lower(F.regexp_extract(text, form, 2))
    power = F.lit(0)
    for u, p in _UNITS.items():
        power = F.when(unit == u, F.lit(p)).otherwise(power)
    size = number.cast("decimal(38,0)") * F.pow(F.lit(1024.0), power).cast("decimal(20,0)")
    bad = F.raise_error(F.concat(F.lit("not a size: "), text)).cast("long")
    return F.when(text.rlike(form) & (size <= (1 << 63) - 1), size.cast("long")).when(text.isNotNull(), bad)


def pretty_size(n: Column) -> Column:
    """Bytes as "512B", "1.5KB" or "0.9765625KB": divided by 1024, to 12 decimals, while the whole
    part has more than three characters; beyond the unit P, an error."""
    v, unit = n.cast("double"), F.lit("")
    wide = lambda x: F.length(F.floor(x).cast("string")) > 3
    for u in [x.upper() for x in _UNITS if x]:
        again = wide(v)
        unit = F.when(again, F.lit(u)).otherwise(unit)
        v = F.when(again, F.rint(v / 1024.0 * 1e12) / 1e12).otherwise(v)
    text = F.rtrim(F.rtrim(v.cast("decimal(38,12)").cast("string"), F.lit("0")), F.lit("."))
    return F.when(wide(v), F.raise_error(F.lit("the size has no unit"))).otherwise(F.concat(text, unit, F.lit("B")))


@F.pandas_udf(T.BinaryType())
def encode_score(score: pd.Series) -> pd.Series:
    """8 bytes that sort as the doubles do; -0.0 equals 0.0, NaN is an error."""
    x = score.to_numpy(dtype=np.float64) + 0.0
    if np.isnan(x).any():
        raise ValueError("the score is not a number")
    bits = x.view(np.uint64)
    top = np.uint64(1 << 63)
    raw = np.where(bits & top, ~bits, bits | top).astype(">u8").tobytes()
    return pd.Series([raw[i : i + 8] for i in range(0, len(raw), 8)])


@F.pandas_udf(T.DoubleType())
def decode_score(code: pd.Series) -> pd.Series:
    u = np.frombuffer(b"".join(code), dtype=">u8").astype(np.uint64)
    top = np.uint64(1 << 63)
    return pd.Series(np.where(u & top, u ^ top, ~u).view(np.float64))


@F.pandas_udf(T.DoubleType())
def decode_double(data: pd.Series) -> pd.Series:
    """The first 8 bytes, little-endian, as a double; fewer are an error."""
    return data.map(lambda b: None if b is None else struct.unpack("<d", b[:8])[0])


@F.pandas_udf(T.LongType())
def decode_long(data: pd.Series) -> pd.Series:
    """8 bytes, little-endian, as a long; any other length is an error."""
    return data.map(lambda b: None if b is None else struct.unpack("<q", b)[0])
