"""Time conventions.

Every table of the library carries time as epoch microseconds (bigint): window
order, cell arithmetic and gaps are then exact integers, whatever the session
zone is.  Hours are counted from ``ORIGIN`` as whole hour boundaries.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def literal_us(moment: datetime | str) -> int:
    """Zone-less moment as epoch microseconds."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    delta = moment.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * SECOND + delta.microseconds


ORIGIN = datetime(2019, 1, 1)
ORIGIN_US = literal_us(ORIGIN)


def us_of(ts: Column | str) -> Column:
    """TIMESTAMP_NTZ (session zone UTC) to epoch microseconds."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def ts_of(us: Column | str) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_div(x: Column, width: int) -> Column:
    """Floor division of a bigint column; rounds down for negatives too."""
    return ((x - F.pmod(x, F.lit(width).cast("bigint"))) / F.lit(width)).cast("bigint")


def hour_of(us: Column | str, delay_us: int = 0) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return floor_div(us + F.lit(delay_us - ORIGIN_US).cast("bigint"), HOUR)


def hour_start(h: Column | str) -> Column:
    h = F.col(h) if isinstance(h, str) else h
    return h * F.lit(HOUR) + F.lit(ORIGIN_US)


def year_of(us: Column | str) -> Column:
    return F.year(ts_of(us)).cast("int")
