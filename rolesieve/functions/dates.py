"""ISO-8601 dates and search-freshness buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesieve.functions.text import let, strip
from rolesieve.registry import FRESHNESS_BUCKETS

_CLOCK = r"(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?"
_DAY = r"\d{4}-\d\d-\d\d|\d{8}|\d{4}-W\d\d(?:-[1-7])?|\d{4}W\d\d[1-7]?"
# Day part, then optionally any one separator character, a time of day and an offset.
_ISO = rf"^(?!0000)({_DAY})(?:(?s:.){_CLOCK}(?:Z|[+-]{_CLOCK})?)?$"


def _calendar_day(digits: Column) -> Column:
    """Eight digits to a date; NULL if there is no such day."""
    return F.try_to_date(digits, "yyyyMMdd")


def _week_day(digits: Column) -> Column:
    """Year, ISO week and optional weekday (``yyyyww`` or ``yyyywwd``) to a date; NULL if out of range."""
    year = F.substring(digits, 1, 4).cast("int")
    week = F.substring(digits, 5, 2).cast("int")
    day = F.coalesce(F.nullif(F.substring(digits, 7, 1), F.lit("")).cast("int"), F.lit(1))
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in week 1
    monday = F.date_sub(fourth, F.weekday(fourth))
    week_start = F.date_add(monday, (week - 1) * 7)
    in_year = week.between(1, 53) & (F.year(F.date_add(week_start, 3)) == year)
    return F.when(in_year, F.date_add(week_start, day - 1))


def parse_iso_date(text: Column) -> Column:
    """The calendar date written in an ISO-8601 date or date-time; NULL for anything else.

    The offset is ignored on purpose: the date is the one on the page.
    """
    return let(
        F.regexp_extract(strip(text), _ISO, 1),
        lambda day: F.when(
            F.contains(day, F.lit("W")), _week_day(F.regexp_replace(day, "[-W]", ""))
        ).when(day != "", _calendar_day(F.replace(day, F.lit("-"), F.lit("")))),
    )


def freshness_bucket(days: Column) -> Column:
    """Smallest search-freshness code that covers ``days``; NULL when none does."""
    result = None
    for limit, code in FRESHNESS_BUCKETS:
        test = days <= limit
        result = F.when(test, F.lit(code)) if result is None else result.when(test, F.lit(code))
    return result
