"""Timestamps as whole microseconds, without regard to the session's time zone."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    i = c.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    part = lambda f: F.extract(F.lit(f), i).cast("long")
    return ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60_000_000 + (F.extract(F.lit("SECOND"), i) * 1_000_000).cast("long")


def instant(us: int) -> Column:
    """The timestamp at so many microseconds: a literal, which scans can compare with their statistics."""
    return F.lit((datetime(1970, 1, 1) + timedelta(microseconds=us)).isoformat(" ")).cast("timestamp_ntz")


def moment(us: Column) -> Column:
    """The timestamp without time zone at so many microseconds."""
    part = (us * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), part)


def seconds(later: Column, earlier: Column) -> Column:
    """Difference of two columns of microseconds in seconds."""
    return (later - earlier) / F.lit(1e6)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))
