"""Times as agent schedulers store them: packed integers in the local time of the instance.

All results are UTC and need ``spark.sql.session.timeZone = UTC``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _pair(value: Column, unit: int) -> Column:
    """Two decimal digits of a packed integer; ``unit`` is 1, 100 or 10000."""
    return (F.floor(value / unit) % 100).cast("int")


def local_to_utc(local: Column, zone: str) -> Column:
    """Local wall-clock time to UTC.

    A time in a spring gap takes the standard offset, as Spark does already. A time in an autumn
    overlap, of an hour or of half an hour, also takes the standard offset, the later of the two
    instants; Spark takes the earlier.
    """
    local = local.cast("timestamp")
    if zone.upper() in ("UTC", "ETC/UTC", "Z"):
        return local
    first = F.to_utc_timestamp(local, zone)
    result = first
    for shift in ("INTERVAL '30' MINUTE", "INTERVAL '1' HOUR"):
        later = first + F.expr(shift)
        result = F.when(F.from_utc_timestamp(later, zone) == local, later).otherwise(result)
    return result


def packed_to_utc(date: Column, time: Column, zone: str = "UTC") -> Column:
    """yyyyMMdd and HHmmss to UTC; null for the "never ran" date 0 and for impossible dates."""
    local = F.try_make_timestamp_ntz(
        F.floor(date / 10000).cast("int"), _pair(date, 100), _pair(date, 1),
        F.floor(time / 10000).cast("int"), _pair(time, 100), _pair(time, 1).cast("decimal(16,6)"),
    )
    return local_to_utc(F.when(date > 0, local), zone)


def packed_seconds(duration: Column) -> Column:
    """HHmmss to seconds; hours are unbounded, nothing below zero."""
    hours = F.floor(duration / 10000).cast("bigint")
    seconds = hours * 3600 + _pair(duration, 100) * 60 + _pair(duration, 1)
    return F.when(duration > 0, seconds).otherwise(F.lit(0)).cast("bigint")


def packed_interval(duration: Column) -> Column:
    """HHmmss to a day-time interval; hours are unbounded."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), packed_seconds(duration).cast("decimal(18,6)"))


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def execution_key(job_id: Column, started_at: Column) -> Column:
    """Identity of an execution whose scheduler has none: job and start second."""
    return F.concat(F.lower(job_id), F.lit(":"), F.date_format(started_at, "yyyyMMddHHmmss"))


def history_position(watermark: Column) -> Column:
    """Watermark text of a history reader; anything that is not a plain number counts as 0."""
    return F.when(watermark.rlike(r"\A[0-9]+\z"), F.coalesce(watermark.try_cast("bigint"), F.lit(0))).otherwise(
        F.lit(0)
    ).cast("bigint")


def poll_position(watermark: Column, poll_started: Column, lookback_seconds: int = 86400) -> Column:
    """Watermark text of a polling reader; unreadable or missing text means one look-back ago."""
    return F.coalesce(watermark.try_cast("timestamp"), plus_seconds(poll_started, F.lit(-lookback_seconds)))
