"""Dates of events with the precision that was given: a year, a month or a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$"


def period(text: Column) -> Column:
    """Struct of first and last day; null where the text is no real period of 1900 to 2200."""
    year, month, day = (F.regexp_extract(text, _FORM, k) for k in (1, 2, 3))
    real = text.rlike(_FORM) & year.try_cast("int").between(1900, 2200) & ~((month == "") & (day != ""))
    first = F.try_to_date(F.concat_ws("-", year, F.when(month == "", "01").otherwise(month), F.when(day == "", "01").otherwise(day)), "yyyy-MM-dd")
    last = F.when(month == "", F.make_date(year.try_cast("int"), F.lit(12), F.lit(31))).when(day == "", F.last_day(first)).otherwise(first)
    return F.when(real & first.isNotNull(), F.struct(first.alias("first"), last.alias("last")))


def event_dates(texts: Column, most: int = 8) -> Column:
    """Sorted distinct periods; a timestamp counts as its day."""
    days = F.transform(texts, lambda x: F.regexp_replace(F.trim(x), r"^(\d{4}-\d{2}-\d{2})[T ].*$", "$1"))
    return F.slice(F.array_sort(F.array_distinct(F.filter(days, lambda x: period(x).isNotNull()))), 1, most)


def interval(dates: Column) -> Column:
    """Struct of start and end (its last second) of what the periods span; null without any."""
    known = F.filter(F.transform(dates, period), lambda p: p.isNotNull())
    start = F.array_min(F.transform(known, lambda p: p["first"])).cast("timestamp")
    end = F.array_max(F.transform(known, lambda p: p["last"])).cast("timestamp") + F.expr("INTERVAL 23 HOURS 59 MINUTES 59 SECONDS")
    return F.when(F.size(known) > 0, F.struct(start.alias("start"), end.alias("end")))


def age_days(then: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000.0))
