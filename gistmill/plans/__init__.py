"""Queries of the engine, by name, and the SQL that each is held against."""

from gistmill.plans import context_queries, curation_queries, retrieval_queries, stats_queries, write_queries  # noqa: F401
from gistmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
