"""Epoch-millisecond helpers; ``as_of`` replaces every clock read."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Union

from pyspark.sql import Column, functions as F

MS_PER_SECOND = 1000
MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000

AsOf = Union[int, datetime, Column]


def as_of_millis(as_of: AsOf) -> int:
    """Driver-side epoch milliseconds of a literal ``as_of``."""
    if isinstance(as_of, datetime):
        at = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
        return int(at.timestamp() * 1000)
    if isinstance(as_of, bool) or not isinstance(as_of, int):
        raise TypeError("as_of must be epoch milliseconds or a datetime here")
    return as_of


def as_of_ms(as_of: AsOf) -> Column:
    """``as_of`` as a bigint column. A timestamp Column means one instant per row."""
    if isinstance(as_of, Column):
        return F.unix_millis(as_of)
    return F.lit(as_of_millis(as_of)).cast("bigint")


def as_of_ts(as_of: AsOf) -> Column:
    """``as_of`` as a timestamp column, independent of the session time zone."""
    if isinstance(as_of, Column):
        return as_of
    return F.timestamp_millis(F.lit(as_of_millis(as_of)).cast("bigint"))


def known_epoch(name: str) -> Column:
    """Sources write 0 for a missing epoch; turn it into null."""
    return F.nullif(F.col(name), F.lit(0).cast("bigint"))


def hours(ms: Column) -> Column:
    return ms / F.lit(MS_PER_HOUR)
