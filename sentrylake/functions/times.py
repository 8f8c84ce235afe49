"""Times as the sensors write them: ISO-8601 with or without an offset, or epoch seconds or milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _iso(text: Column) -> Column:
    """A timestamp of a text that begins with a digit (words such as now and today are no times)."""
    return F.try_to_timestamp(F.when(text.rlike("^[0-9]"), text))


def parse_time(c: Column) -> Column:
    """A timestamp, or null. Numbers over 1e12 are milliseconds, others seconds; a time without an offset is UTC."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_seconds(seconds), _iso(text))


def graph_seconds(c: Column) -> Column:
    """Seconds as a double, 0 where there is no time; numbers are seconds whatever their size."""
    text = F.trim(c.cast("string"))
    return F.coalesce(text.try_cast("double"), F.unix_micros(_iso(text)) / F.lit(1e6), F.lit(0.0))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def bucket(epoch_ms: Column, minutes: int) -> Column:
    """The number of the tumbling window of so many minutes."""
    return F.floor(epoch_ms / (minutes * 60_000)).cast("long")
