"""Time windows and order that a question names, in English or Russian.

A question is one short string: the rules are plain Python, and ``question_time`` applies them to a column in Arrow batches.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that name a window relative to today, in the order in which they are tried.
DAY_BEFORE_YESTERDAY = r"\b(the day before yesterday|позавчера)\b"
YESTERDAY = r"\b(yesterday|вчера)\b"
TODAY = r"\b(today|tonight|this morning|сегодня)\b"
LAST_WEEK = r"\b(last|past|previous) week\b|прошлой неделе"
THIS_WEEK = r"\bthis week\b|этой неделе"
LAST_MONTH = r"\b(last|past|previous) month\b|прошлом месяце"
THIS_MONTH = r"\bthis month\b|этом месяце"
LAST_YEAR = r"\b(last|past|previous) year\b|прошлом году"
THIS_YEAR = r"\bthis year\b|этом году"
RECENTLY = r"\b(recently|lately)\b|недавно"
# How long ago.
AGO = r"\b(\d+|a|an|one|two|three|four|five|six|seven|eight|nine|ten)\s+(day|days|week|weeks|month|months|year|years)\s+ago\b"
AGO_RU = r"\b(\d+)\s+(день|дня|дней|недел[юиь]|месяц|месяца|месяцев|год|года|лет)\s+назад\b"
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
UNITS_RU = {"д": "day", "н": "week", "м": "month", "г": "year", "л": "year"}
MOST_AGO = 1000
# Dates, months by name, years.
ISO_DAY = r"\b(\d{4})-(\d{2})-(\d{2})\b"
ISO_MONTH = r"\b(\d{4})-(\d{2})\b(?!-)"
MONTH = (
    r"\b(january|february|march|april|may|june|july|august|september|october|november|december|"
    r"jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec)\b\.?(?:,?\s+(\d{4}))?"
)
MONTH_RU = r"\b(январ[ьяе]|феврал[ьяе]|март[ае]?|апрел[ьяе]|ма[йяе]|июн[ьяе]|июл[ьяе]|август[ае]?|сентябр[ьяе]|октябр[ьяе]|ноябр[ьяе]|декабр[ьяе])\b(?:\s+(\d{4}))?"
STEMS_RU = {"янв": 1, "фев": 2, "мар": 3, "апр": 4, "ма": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12}
#: These are also ordinary words: months only with a year, or after a cue.
AMBIGUOUS = ("may", "march")
CUE = r"\b(in|during|since|until|by|before|after|of|early|late|mid|last|this|next)$"
YEAR = r"\b(?:in|during|since|в|во|за)\s+(\d{4})(?:\s*(?:году|г\.?))?\b"
FIRST_YEAR, LAST_YEAR_KNOWN = 1900, 2200
# Words that ask for an order, or for a time.
EARLIEST = r"\b(first(?!\s+name)|earliest|initially|originally|at first|впервые|сначала|перв\w*|изначально)\b"
LATEST = r"\b(latest|most recent(?:ly)?|last time|currently|current|now|these days|сейчас|теперь|последн\w*|в последний раз|текущ\w*)\b"
ASKS_TIME = (
    r"\b(when|what date|which day|how long|how many (?:days|weeks|months|years)|before|after|since|until|ago|"
    r"когда|какого числа|сколько (?:дней|недель|месяцев|лет)|до того|после того|давно)\b"
)


@dataclass(frozen=True)
class Window:
    first: dt.date
    last: dt.date

    def overlaps(self, first: dt.date | None, last: dt.date | None) -> bool:
        first, last = first or last, last or first
        return first is not None and self.first <= last and self.last >= first


def _days(today: dt.date, first: int, last: int | None = None) -> Window:
    """Days from and to so many days after today."""
    return Window(today + dt.timedelta(first), today + dt.timedelta(first if last is None else last))


def _month(year: int, month: int) -> Window:
    return Window(dt.date(year, month, 1), dt.date(year, month, calendar.monthrange(year, month)[1]))


def _year(year: int) -> Window | None:
    return Window(dt.date(year, 1, 1), dt.date(year, 12, 31)) if FIRST_YEAR <= year <= LAST_YEAR_KNOWN else None


def _months_back(today: dt.date, n: int) -> Window:
    year, month = divmod(today.year * 12 + today.month - 1 - n, 12)
    return _month(year, month + 1)


_RELATIVE = [
    (DAY_BEFORE_YESTERDAY, lambda t: _days(t, -2)),
    (YESTERDAY, lambda t: _days(t, -1)),
    (TODAY, lambda t: _days(t, 0)),
    (LAST_WEEK, lambda t: _days(t, -t.weekday() - 7, -t.weekday() - 1)),
    (THIS_WEEK, lambda t: _days(t, -t.weekday(), 0)),
    (LAST_MONTH, lambda t: _months_back(t, 1)),
    (THIS_MONTH, lambda t: _days(t, 1 - t.day, 0)),
    (LAST_YEAR, lambda t: _year(t.year - 1)),
    (THIS_YEAR, lambda t: Window(dt.date(t.year, 1, 1), t)),
    (RECENTLY, lambda t: _days(t, -30, 0)),
]


def _number(digits: str) -> int:
    """A whole number; one of many digits is as good as one more than any that counts."""
    digits = digits.lstrip("0")
    return int(digits or "0") if len(digits) <= len(str(MOST_AGO)) else MOST_AGO + 1


def _ago(question: str, today: dt.date) -> Window | None:
    if m := re.search(AGO, question):
        n, unit = NUMBERS.get(m[1]) or _number(m[1]), m[2].removesuffix("s")
    elif m := re.search(AGO_RU, question):
        n, unit = _number(m[1]), UNITS_RU[m[2][0]]
    else:
        return None
    if not 0 < n <= MOST_AGO:
        return None
    if unit == "day":
        return _days(today, -n)
    if unit == "week":  # about then
        return _days(today, -7 * n - 3, -7 * n + 3)
    return _months_back(today, n) if unit == "month" else _year(today.year - n)


def _named_month(question: str, today: dt.date) -> Window | None:
    for pattern in (MONTH, MONTH_RU):
        m = re.search(pattern, question)
        if not m:
            continue
        name, year = m[1], m[2]
        if name in AMBIGUOUS and not year and not re.search(CUE, question[: m.start()].rstrip()):
            continue
        month = STEMS_RU.get(name[:3]) or STEMS_RU.get(name[:2]) or [x.lower() for x in calendar.month_abbr].index(name[:3])
        if year and _year(int(year)) is None:
            continue
        # without a year, the last such month that has begun
        return _month(int(year) if year else today.year - (month > today.month), month)
    return None


def _absolute(question: str, today: dt.date) -> Window | None:
    if (m := re.search(ISO_DAY, question)) and _year(int(m[1])):
        try:
            return _days(dt.date(int(m[1]), int(m[2]), int(m[3])), 0)
        except ValueError:
            return None
    if (m := re.search(ISO_MONTH, question)) and _year(int(m[1])) and 1 <= int(m[2]) <= 12:
        return _month(int(m[1]), int(m[2]))
    if found := _named_month(question, today):
        return found
    return _year(int(m[1])) if (m := re.search(YEAR, question)) else None


def window(question: str, today: dt.date) -> Window | None:
    """The days that a question names, relative ones first."""
    q = question.casefold()
    near = next((make(today) for pattern, make in _RELATIVE if re.search(pattern, q)), None)
    return near or _ago(q, today) or _absolute(q, today)


def order(question: str) -> str | None:
    """``earliest`` or ``latest``; the former where both are named."""
    q = question.casefold()
    return "earliest" if re.search(EARLIEST, q) else "latest" if re.search(LATEST, q) else None


def asks_time(question: str, today: dt.date) -> bool:
    """Whether dates belong to the answer."""
    return bool(re.search(ASKS_TIME, question.casefold())) or window(question, today) is not None


def question_time(question: Column, today: dt.date) -> Column:
    """Struct of first and last day (null without a window), order, and asks_time of each question."""

    @F.pandas_udf("first date, last date, order string, asks_time boolean")
    def parsed(questions: pd.Series) -> pd.DataFrame:
        rows = []
        for q in questions.fillna(""):
            found = window(q, today)
            rows.append((found and found.first, found and found.last, order(q), asks_time(q, today)))
        return pd.DataFrame(rows, columns=["first", "last", "order", "asks_time"])

    return parsed(question)
