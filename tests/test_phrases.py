import datetime as dt

import pytest
from pyspark.sql import functions as F

from gistmill.functions import passages, phrases

TODAY = dt.date(2026, 9, 16)  # a Wednesday


@pytest.mark.parametrize(
    ("question", "first", "last"),
    [
        ("what did I say yesterday?", (2026, 9, 15), (2026, 9, 15)), ("что было вчера", (2026, 9, 15), (2026, 9, 15)), ("позавчера", (2026, 9, 14), (2026, 9, 14)),
        ("plans from last week", (2026, 9, 7), (2026, 9, 13)), ("last month", (2026, 8, 1), (2026, 8, 31)), ("in December", (2025, 12, 1), (2025, 12, 31)), ("in may", (2026, 5, 1), (2026, 5, 31)),
        ("2 weeks ago", (2026, 8, 30), (2026, 9, 5)), ("3 месяца назад", (2026, 6, 1), (2026, 6, 30)), ("five weeks ago", (2026, 8, 9), (2026, 8, 15)), ("this week", (2026, 9, 14), (2026, 9, 16)), ("5 дней назад", (2026, 9, 11), (2026, 9, 11)), ("lately", (2026, 8, 17), (2026, 9, 16)), ("last march", (2026, 3, 1), (2026, 3, 31)), ("в мае 2024", (2024, 5, 1), (2024, 5, 31)), ("during 2023", (2023, 1, 1), (2023, 12, 31)), ("на прошлой неделе", (2026, 9, 7), (2026, 9, 13)), ("Sept. 2025", (2025, 9, 1), (2025, 9, 30)), ("a year ago", (2025, 1, 1), (2025, 12, 31)), ("on 2026-03-14", (2026, 3, 14), (2026, 3, 14)), ("2026-02", (2026, 2, 1), (2026, 2, 28)), ("в марте 2024", (2024, 3, 1), (2024, 3, 31)),
    ],
)
def test_windows(question, first, last):
    assert phrases.window(question, TODAY) == phrases.Window(dt.date(*first), dt.date(*last))


@pytest.mark.parametrize("question", ["may I ask", "march on", "march of the penguins documentary", "2026-02-30", "no time here", "", "notes from 0000-01", "what happened in January 0000", "on 0000-01-01", "2000 years ago", "0 days ago"])
def test_no_window(question):
    assert phrases.window(question, TODAY) is None


def test_order_and_overlap():
    assert phrases.order("the latest plan, and what was it originally") == "earliest" and phrases.order("most recent") == "latest" and phrases.order("what is my first name") is None
    assert phrases.order("when did I first try sushi") == "earliest" and phrases.order("what is my current job") == "latest" and phrases.order("favourite colour") is None
    assert phrases.asks_time("how many days between the trips", TODAY) and phrases.asks_time("yesterday", TODAY) and not phrases.asks_time("favourite colour", TODAY)
    w = phrases.window("last month", TODAY)
    assert w.overlaps(dt.date(2026, 8, 31), None) and not w.overlaps(dt.date(2026, 9, 1), None) and not w.overlaps(None, None)


def test_questions_of_a_column(spark):
    df = spark.createDataFrame([("last month",), (None,), ("the latest",)], "q string").select(phrases.question_time(F.col("q"), TODAY).alias("t"))
    assert [tuple(r.t) for r in df.collect()] == [(dt.date(2026, 8, 1), dt.date(2026, 8, 31), None, True), (None, None, None, False), (None, None, "latest", False)]


def test_passages(spark):
    said = "One sentence here. " * 200 + "\n\n" + "x" * 3000
    found = passages.spans(said)
    assert all(0 < b - a <= 2400 for a, b in found) and [a for a, _ in found[1:]] == [b for _, b in found[:-1]] and said[slice(*found[0])].endswith(". ")
    assert said[found[-1][1] :].strip() == "x" * 3000  # what has no end within reach is not cut
    df = spark.createDataFrame([("short",), (None,), (said,), (" \n ",)], "t string").select(passages.passages("t").alias("p"))
    rows = [[(x.start, x.end) for x in r.p] for r in df.collect()]
    assert rows == [[(0, 5)], [], found, []]


def test_passages_keep_sentences_whole():
    assert passages.spans("y" * 3000) == []
    late = "w " * 700 + "end. " + "z" * 100
    assert passages.spans(late) == [(0, 1405), (1405, 1505)]  # the first end beyond the size
    mixed = "First. " + "a" * 500 + "\n\n" + "b" * 400 + "! " + "c" * 900
    assert passages.spans(mixed) == [(0, 911), (911, 1811)]  # the last end within the size, of whichever kind
    assert len(passages.spans("A sentence of some length. " * 1000)) == 8
    assert passages.spans("…" * 1300) == []


def test_numbers_of_many_digits(spark):
    """Any text is answered, however long its numbers are."""
    for said in ("9" * 5000 + " days ago", "0" * 5000 + "2 days ago", "9" * 5000 + " дней назад", "in " + "2" * 5000):
        df = spark.createDataFrame([(said,)], "q string").select(phrases.question_time(F.col("q"), TODAY).alias("t"))
        start = df.first().t[0]
        assert start == (TODAY - dt.timedelta(days=2) if said.startswith("0") else None)
