"""Event time: parsing, buckets, replay."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_zoned(value: Column) -> Column:
    """ISO 8601 with a zone as a timestamp; anything else is null."""
    return F.try_to_timestamp(value)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def bucket_end(t: Column, upper: Column, size: int) -> Column:
    """The exclusive end of the bucket of t, where buckets of that size end at upper and at every size before and after."""
    if size <= 0:
        raise ValueError("a bucket's size must be above 0")
    offset = F.pmod(upper, F.lit(size))
    return offset + (F.floor((t - offset) / F.lit(size)) + 1) * size


def interval_micros(text: str) -> int:
    """"30 minutes" as microseconds."""
    units = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
    number, unit = text.split()
    return int(number) * units[unit.rstrip("s")]


def replay_time(start: float, first: float, t: float, speedup: float) -> int:
    """When an event is emitted, if events since first are replayed speedup times as fast from start on."""
    if speedup <= 0:
        raise ValueError("the speed-up must be above 0")
    return int(start + math.ceil((t - first) / speedup))


def replay_column(t: Column, first: Column, start: Column, speedup: float) -> Column:
    if speedup <= 0:
        raise ValueError("the speed-up must be above 0")
    return start + F.ceil((t - first) / F.lit(float(speedup)))


def format_duration(ms: int) -> str:
    """"1d 02:03:04.005"."""
    sign, ms = ("-", -ms) if ms < 0 else ("", ms)
    seconds, ms = divmod(ms, 1000)
    minutes, seconds = divmod(seconds, 60)
    hours, minutes = divmod(minutes, 60)
    days, hours = divmod(hours, 24)
    return f"{sign}{days}d {hours:02}:{minutes:02}:{seconds:02}.{ms:03}"


def format_timestamp(ts: Column) -> Column:
    """"2012-02-02 01:09:00.000"."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")
