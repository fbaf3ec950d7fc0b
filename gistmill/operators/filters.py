"""The filter algebra, compiled to one Column; Catalyst pushes it down.

``{"all": [...]}`` joins filters; ``{"field": path, "op": op, "value": value}`` with op ``exists``, ``absent``, ``eq`` or
``in`` tests a field.  A dotted path reaches into structs and maps; a path that does not exist is null.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("exists", "absent", "eq", "in")


class InvalidFilter(ValueError):
    """A filter that is not of the algebra."""


def validate(expression: dict[str, Any] | None) -> None:
    if not expression:
        return
    if "all" in expression:
        if set(expression) != {"all"} or not isinstance(expression["all"], list) or not all(isinstance(x, dict) for x in expression["all"]):
            raise InvalidFilter("'all' takes a list of filters, and nothing beside it")
        for x in expression["all"]:
            validate(x)
        return
    field, op = expression.get("field"), expression.get("op")
    if set(expression) - {"field", "op", "value"} or not isinstance(field, str) or not field:
        raise InvalidFilter("a filter has a field, an op and a value")
    if op not in OPS:
        raise InvalidFilter(f"an op is one of {', '.join(OPS)}, not {op!r}")
    if op == "in" and not isinstance(expression.get("value"), list):
        raise InvalidFilter("'in' takes a list")


def _reach(schema: T.StructType, path: str) -> tuple[Column | None, T.DataType | None]:
    first, *rest = path.split(".")
    if first not in schema.names:
        return None, None
    at, kind = F.col(f"`{first}`"), schema[first].dataType
    for part in rest:
        if isinstance(kind, T.StructType) and part in kind.names:
            at, kind = at[part], kind[part].dataType
        elif isinstance(kind, T.MapType):
            at, kind = F.element_at(at, part), kind.valueType
        else:
            return None, None
    return at, kind


def _equals(at: Column, kind: T.DataType, value: Any) -> Column:
    """Equality of one type; a boolean is no number, and a number no text."""
    same = (
        value is None
        or isinstance(value, bool) == isinstance(kind, T.BooleanType)
        and (isinstance(value, str) == isinstance(kind, T.StringType) or isinstance(kind, (T.ArrayType, T.MapType, T.StructType)))
    )
    if not same:
        return F.lit(False)
    if isinstance(value, list):
        return F.coalesce(at == F.array(*map(F.lit, value)), F.lit(False)) if isinstance(kind, T.ArrayType) else F.lit(False)
    return at.eqNullSafe(F.lit(value))


def compiled(expression: dict[str, Any] | None, schema: T.StructType) -> Column:
    validate(expression)
    if not expression:
        return F.lit(True)
    if "all" in expression:
        out = F.lit(True)
        for x in expression["all"]:
            out = out & compiled(x, schema)
        return out
    at, kind = _reach(schema, expression["field"])
    op, value = expression["op"], expression.get("value")
    if at is None:
        return F.lit(op == "absent" or op == "eq" and value is None or op == "in" and None in value)
    if op == "exists":
        return at.isNotNull()
    if op == "absent":
        return at.isNull()
    if op == "eq":
        return _equals(at, kind, value)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(at, lambda x: _any(x, kind.elementType, value)), F.lit(False))
    return _any(at, kind, value)


def _any(at: Column, kind: T.DataType, values: list) -> Column:
    out = F.lit(False)
    for value in values:
        out = out | _equals(at, kind, value)
    return out


def matching(rows: DataFrame, expression: dict[str, Any] | None) -> DataFrame:
    return rows.filter(compiled(expression, rows.schema))


def live(now: Column) -> Column:
    """Active and not past its validity; whether it was reviewed plays no part."""
    return (F.col("status") == "active") & (F.col("valid_until").isNull() | (F.col("valid_until") > now))


def in_range(since: Column | None, until: Column | None) -> Column:
    """Whether the event, or else the day it was said, falls in a window."""
    start, end = F.coalesce("event_start", "event_end", "document_date"), F.coalesce("event_end", "event_start", "document_date")
    out = start.isNotNull()
    if since is not None:
        out = out & (end >= since)
    return out & (start <= until) if until is not None else out
