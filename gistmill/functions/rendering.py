"""Rows as the lines of a prompt: candidates and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for an empty list; fixed value.
NONE = "(none)"


def _joined(items: Column, head: str) -> Column:
    """The items behind a head, or nothing where there are none."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit(head), F.array_join(items, "," if head.endswith("=") else ", "))).otherwise("")


def context_text(context: Column) -> Column:
    """A map of strings in order of its keys, each in single quotes."""
    pairs = F.transform(F.array_sort(F.map_entries(context)), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'")))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(pairs, ", "), F.lit("")), F.lit("}"))


def candidate(id_: Column, kind: Column, said: Column, events: Column, context: Column, importance: Column, text: Column) -> Column:
    """A candidate with the day on which it was said and its event dates, where it has them."""
    day = F.coalesce(F.concat(F.lit(" said="), F.date_format(said, "yyyy-MM-dd")), F.lit(""))
    return F.concat(F.lit("- id="), id_, F.lit(" kind="), kind, day, _joined(events, " events="), F.lit(" context="), context_text(context), F.lit(" importance="), importance.cast("string"), F.lit(": "), text)


def entity(ref: Column, label: Column, name: Column, aliases: Column) -> Column:
    """A numbered entity with the names that people say for it."""
    return F.concat(ref.cast("string"), F.lit(". "), label, F.lit(": "), name, _joined(aliases, " — aliases: "))


def lines(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, lines: each key's rows of ``line`` in order, or ``NONE`` where all are null; a prompt holds a bounded number of them."""
    of_one = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    return of_one.select(key, F.when(joined == "", NONE).otherwise(joined).alias("lines"))
