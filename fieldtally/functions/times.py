"""Tolerant date parsing to wall-clock timestamps. Text that does not have the
stated form becomes null, and so does a time that a zone's clocks skip; nothing raises
under ANSI mode and nothing depends on the session time zone."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted text forms, and the order of their parts as year,
# month, day.
DATE_FORMS = {
    "ymd": "([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})",
    "mdy": "([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})",
}
ISO_ORDER = {"ymd": None, "mdy": "$3-$1-$2"}
# Fixed value: the zone in which visits are recorded.
ZONE = "America/Los_Angeles"
TIME_FORMS = {
    "seconds": "[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}",
    "minutes": "[0-9]{1,2}:[0-9]{1,2}",
}


def parse_date(text: Column, form: str = "ymd") -> Column:
    return _parse(text, form, "")


def parse_datetime(
    date: Column,
    time: Column,
    date_form: str = "ymd",
    time_form: str = "seconds",
    zone: str = ZONE,
) -> Column:
    """Date and time texts together; null if either is missing or malformed, or if the
    clocks of ``zone`` never showed that time."""
    moment = _parse(F.concat(date, F.lit(" "), time), date_form, " " + TIME_FORMS[time_form])
    return shown_by_clocks(moment, zone)


def shown_by_clocks(moment: Column, zone: str = ZONE) -> Column:
    """The moment, or null if it was skipped when the clocks of ``zone`` were put forward:
    on the way to UTC and back such a time comes out later. Only hours of the day in which
    that zone ever skipped a time are sent there, as the conversion is costly."""
    there = F.convert_timezone(F.lit(zone), F.lit("UTC"), moment)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), there)
    asked = F.hour(moment).isin(list(skipped_hours(zone)))
    return F.when(asked, F.when(back == moment, moment)).otherwise(moment)


@lru_cache
def skipped_hours(zone: str) -> tuple[int, ...]:
    """Hours of the day of which a part was skipped on some day since 1850; all of them
    where the zone is not known here."""
    try:
        rules = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError):
        return tuple(range(24))
    found, day = set(), timedelta(days=1)
    start = datetime(1850, 1, 1, tzinfo=timezone.utc)
    for at in (start + day * n for n in range(190 * 366)):
        if (at + day).astimezone(rules).utcoffset() > at.astimezone(rules).utcoffset():
            before, after = at, at + day
            while after - before > timedelta(seconds=1):
                middle = before + (after - before) // 2
                same = middle.astimezone(rules).utcoffset() == at.astimezone(rules).utcoffset()
                before, after = (middle, after) if same else (before, middle)
            first = before.astimezone(rules).replace(tzinfo=None)
            last = after.astimezone(rules).replace(tzinfo=None)
            hours = int((last - first).total_seconds()) // 3600 + 1
            found |= {(first + timedelta(seconds=1, hours=h)).hour for h in range(hours)}
    return tuple(sorted(found))


def to_minute(moment: Column) -> Column:
    """Drop seconds (date_trunc would turn the value into a zoned one)."""
    return F.substring(moment.cast("string"), 1, 16).cast("timestamp_ntz")


def _parse(text: Column, form: str, rest: str) -> Column:
    """The cast takes more forms than are accepted, so the text is tested first."""
    order = ISO_ORDER[form]
    iso = text if order is None else F.regexp_replace(text, f"^{DATE_FORMS[form]}", order)
    return F.when(text.rlike(f"^{DATE_FORMS[form]}{rest}$"), iso.try_cast("timestamp_ntz"))
