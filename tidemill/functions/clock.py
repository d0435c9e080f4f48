"""Time helpers.  ``now`` is always an explicit value, never the wall clock.

Timestamps are UTC (session time zone UTC); a business day is a day in Seoul,
which has had no daylight saving since 1988, so its offset is a fixed nine hours.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE_HOURS = 9


def at(now: datetime | str | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp_ntz")


def utc(at: datetime) -> datetime:
    """A time with an offset as the UTC time without one; any other is UTC already."""
    return at if at.tzinfo is None else at.astimezone(UTC).replace(tzinfo=None)


def local(ts: Column) -> Column:
    """Wall-clock time in the business zone."""
    return ts + F.expr(f"INTERVAL {ZONE_HOURS} HOURS")


def local_day(ts: Column) -> Column:
    return F.to_date(local(ts))


def day_cutoff(now: Column) -> Column:
    """The instant the business day of ``now`` began: date-only deadlines before it have passed."""
    return F.date_trunc("day", local(now)).cast("timestamp_ntz") - F.expr(f"INTERVAL {ZONE_HOURS} HOURS")


def hours_before(now: Column, hours: int) -> Column:
    return now - F.expr(f"INTERVAL {int(hours)} HOURS")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end with microseconds."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def in_quiet_hours(now: Column, start: str, end: str) -> Column:
    """Whether the local time lies in ``[start, end)``; a window may pass midnight, an empty one is never quiet."""
    clock = F.date_format(local(now), "HH:mm")
    if start == end:
        return F.lit(False)
    if start < end:
        return (clock >= start) & (clock < end)
    return (clock >= start) | (clock < end)


def quiet_end(now: Column, end: str) -> Column:
    """The next instant at which quiet hours end."""
    today = F.date_trunc("day", local(now)).cast("timestamp_ntz")
    hour, minute = map(int, end.split(":"))
    stop = today + F.expr(f"INTERVAL '{hour}:{minute}' HOUR TO MINUTE")
    stop = F.when(stop <= local(now), stop + F.expr("INTERVAL 1 DAY")).otherwise(stop)
    return stop - F.expr(f"INTERVAL {ZONE_HOURS} HOURS")


def bucket(ts: Column, minutes: int) -> Column:
    """Number of the tumbling interval that holds ``ts``."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(60_000_000 * minutes)).cast("long")


# Seconds of the units in relative times, Korean and English.
UNIT_SECONDS = {"초": 1, "분": 60, "시간": 3600, "일": 86400, "주": 604800, "개월": 2592000, "달": 2592000, "년": 31536000,
                "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}


def relative_time(raw: Column, now: Column) -> Column:
    """The approximate instant of texts such as ``3시간 전`` or ``2 days ago``; null if not such a text."""
    number = F.regexp_extract(raw, r"(\d{1,6})\s*(초|분|시간|일|주|개월|달|년|second|minute|hour|day|week|month|year)s?\s*(?:전|ago)", 1)
    unit = F.regexp_extract(raw, r"(\d{1,6})\s*(초|분|시간|일|주|개월|달|년|second|minute|hour|day|week|month|year)s?\s*(?:전|ago)", 2)
    table = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    seconds = number.try_cast("long") * F.try_element_at(table, unit)
    ago = now - F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.when(raw.rlike(r"^\s*(?:방금|just now)"), now).when(raw.rlike(r"^\s*(?:어제|yesterday)"), now - F.expr("INTERVAL 1 DAY")).when(number != "", ago)


def parse_iso(value: Column) -> Column:
    """``(at, precision, raw)``: a date is a local midnight of precision day, an offset makes it exact, else unknown."""
    text = F.trim(value)
    is_day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    has_zone = text.rlike(r"T.*(?:Z|[+-]\d{2}:?\d{2})$")
    date_at = F.try_to_timestamp(F.when(is_day, text), F.lit("yyyy-MM-dd")) - F.expr(f"INTERVAL {ZONE_HOURS} HOURS")
    exact_at = F.try_to_timestamp(F.when(has_zone, text))
    found = F.coalesce(date_at, exact_at)
    precision = F.when(date_at.isNotNull(), "day").when(exact_at.isNotNull(), "exact").otherwise("unknown")
    return F.struct(found.alias("at"), precision.alias("precision"), value.alias("raw"))
