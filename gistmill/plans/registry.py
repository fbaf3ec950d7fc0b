"""The queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from gistmill.sources import fixtures

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), and DuckDB SQL that may name the projected relations."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = fixtures.oracle(sql)
        return f

    return put
