"""Time arithmetic. Sessions run in UTC, so wall-clock values convert without shifts."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def as_ts(value) -> Column:
    """Literal or column as a zone-free timestamp; the run's ``as_of`` becomes a foldable literal."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_micros(c) -> Column:
    return F.unix_micros(_col(c).cast("timestamp"))


def _boundaries(start, end, micros: int) -> Column:
    def tick(c):
        return F.floor(epoch_micros(c) / F.lit(micros)).cast("long")

    return tick(end) - tick(start)


def minutes_between(start, end) -> Column:
    """Number of minute boundaries crossed from start to end (not elapsed minutes)."""
    return _boundaries(start, end, 60_000_000)


def seconds_between(start, end) -> Column:
    return _boundaries(start, end, 1_000_000)


def millis_between(start, end) -> Column:
    return _boundaries(start, end, 1_000)
