"""Time helpers shared by batch and streaming operators."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def interval_seconds(value: str | int | float) -> int:
    """'24 hours' / '30 minutes' / 90 -> seconds."""
    if isinstance(value, (int, float)):
        return int(value)
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", value.lower())
    if not m or m.group(2) not in _UNITS:
        raise ValueError(f"cannot read interval {value!r}")
    return int(m.group(1)) * _UNITS[m.group(2)]


def ts_literal(value: str | datetime) -> Column:
    """A TIMESTAMP_NTZ literal (event times are naive UTC)."""
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp_ntz")


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since the epoch for a naive UTC timestamp (no session-zone shift)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                           col.cast("timestamp_ntz"))


def minute_bucket(ts: Column | str) -> Column:
    """Minute key yyyyMMddHHmm, the per-minute counter key."""
    return F.date_format(ts, "yyyyMMddHHmm")
