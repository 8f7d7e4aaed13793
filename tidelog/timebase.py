"""Ticks of 100 ns since 0001-01-01 UTC, windows aligned to tick 0, and injected clocks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_PER_SECOND = 10_000_000
TICKS_PER_HOUR = 3600 * TICKS_PER_SECOND
TICKS_PER_DAY = 24 * TICKS_PER_HOUR
#: 1970-01-01 in ticks, a fixed value.
UNIX_EPOCH = 621_355_968_000_000_000


def ticks_of(ts: Column | str) -> Column:
    """Ticks of a timestamp, with or without zone (taken as UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) * 10 + UNIX_EPOCH


def timestamp_of(ticks: Column | str) -> Column:
    """Timestamp of ticks; the last digit of 100 ns is lost."""
    t = F.col(ticks) if isinstance(ticks, str) else ticks
    return F.timestamp_micros(floor_div(t - UNIX_EPOCH, 10))


def stored_between(ts: str, start: int | None = None, end: int | None = None) -> Column:
    """[start, end) in ticks as a condition on a stored timestamp column itself, which
    reaches the scan; whole microseconds, so times of 100 ns are tested again after it."""
    c, out = F.col(ts), F.lit(True)
    moment = lambda micros: F.lit(datetime(1970, 1, 1) + timedelta(microseconds=micros)).cast("timestamp_ntz")
    if start is not None:
        out = out & (c >= moment((start - UNIX_EPOCH) // 10))
    if end is not None:
        out = out & (c < moment(-((UNIX_EPOCH - end) // 10)))
    return out


def floor_div(t: Column, n: int) -> Column:
    """Quotient rounded down, in integers: ``div`` alone truncates, and ``/`` is a double,
    which ticks exceed."""
    return F.call_function("div", t - F.pmod(t, F.lit(n)), F.lit(n))


def window_start(t: Column | str, width: int) -> Column:
    """Start of the window of ``width`` ticks; windows are multiples of it from tick 0."""
    c = F.col(t) if isinstance(t, str) else t
    return c - F.pmod(c, F.lit(width))


def expiry_of(now: int, ttl: Column) -> Column:
    """now + ttl; 0, for never, where ttl is null."""
    return F.when(ttl.isNull(), F.lit(0)).otherwise(F.lit(now) + ttl)


def expired(expiry: Column, now: int) -> Column:
    """The expiry instant itself counts as expired; 0 never does."""
    return (expiry != 0) & (expiry <= F.lit(now))
