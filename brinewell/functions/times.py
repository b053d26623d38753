"""Instants and the local week window."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinewell.functions.text import strip

ZONE = "Europe/Stockholm"


def parse_instant(c: Column) -> Column:
    """A timestamp from epoch seconds, as number or text, or ISO-8601 with a whole date; a text without zone is UTC; anything else raises."""
    s = strip(c.cast("string"))
    number = s.try_cast("double")
    epoch = F.when(number.isNotNull(), F.timestamp_micros(F.bround(number * 1000000).cast("long")))
    whole = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ].*)?$"), s)
    parsed = F.coalesce(epoch, F.try_to_timestamp(F.regexp_replace(whole, "Z", "+00:00")))
    return F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("unsupported instant: "), F.coalesce(s, F.lit("null")))).cast("timestamp")).otherwise(parsed)


def iso_utc(c: Column) -> Column:
    """ISO text in UTC that ends in Z, without a fraction that is zero. The session's zone must be UTC."""
    return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.0+Z$", "Z")


def week_start(c: Column, zone: str = ZONE) -> Column:
    """The instant at which the local week (from Monday 00:00) of an instant begins."""
    return F.to_utc_timestamp(F.date_trunc("week", F.from_utc_timestamp(c, zone)), zone)


def week_end(c: Column, zone: str = ZONE) -> Column:
    """The instant at which that week ends: seven days later on the local clock, so 167 to 169 hours."""
    return F.to_utc_timestamp(F.date_trunc("week", F.from_utc_timestamp(c, zone)) + F.expr("interval 7 days"), zone)


def week_window(monday: date | str | None = None, zone: str = ZONE, now: datetime | None = None) -> tuple[datetime, datetime, datetime, datetime]:
    """Local start and end and UTC start and end (half-open) of a week; by default the last complete one."""
    tz = ZoneInfo(zone)
    if monday is None:
        today = (now or datetime.now(timezone.utc)).astimezone(tz).date()
        day = today - timedelta(days=today.weekday() + 7)
    else:
        day = date.fromisoformat(monday) if isinstance(monday, str) else monday
        if day.weekday():
            raise ValueError("a week starts on a Monday")
    start = datetime(day.year, day.month, day.day, tzinfo=tz)
    end_day = day + timedelta(days=7)
    end = datetime(end_day.year, end_day.month, end_day.day, tzinfo=tz)
    return start, end, start.astimezone(timezone.utc), end.astimezone(timezone.utc)
