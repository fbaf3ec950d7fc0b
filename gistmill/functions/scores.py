"""Scores of retrieval: similarity, decay, fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill.functions.dates import age_days


@dataclass(frozen=True)
class Policy:
    """A versioned set of weights; the extra signals are off unless set."""

    name: str = "neutral-v1"
    dense: float = 0.60
    lexical: float = 0.30
    entity: float = 0.10
    importance: float = 0.10
    recency: float = 0.05
    floor: float = 0.18
    trusted: tuple[str, ...] = ("user", "manual", "tool")
    half_life: float = 180.0
    episode_half_life: float = 0.0
    episode_significance: float = 1.0
    temporal: float = 0.0
    order: float = 0.0
    reinforcement: float = 0.0
    inference_penalty: float = 0.0


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; the cosine, where both have length one."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def reinforcement(mentions: Column) -> Column:
    return F.least(F.lit(1.0), F.log2(F.greatest(F.lit(1), mentions).cast("double")) / 3.0)


def recency(policy: Policy, now: Column, kind: Column, importance: Column, updated: Column, event_start: Column, event_end: Column, said: Column) -> Column:
    plain = F.exp(-age_days(updated, now) / policy.half_life)
    if policy.episode_half_life <= 0:
        return plain
    anchor = F.coalesce(event_end, event_start, said, updated)
    fading = (kind == "episode") & (importance.cast("double") < policy.episode_significance)
    return F.when(fading, F.exp(-age_days(anchor, now) / policy.episode_half_life)).otherwise(plain)


def relevance(policy: Policy, dense: Column, lexical: Column, entity: Column) -> Column:
    return policy.dense * dense + policy.lexical * lexical + policy.entity * entity


def call_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Cost at prices for a million tokens; an unknown model costs as the dearest."""
    dear = tuple(max(p[k] for p in prices.values()) for k in (0, 1))
    of = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, p[k])]), model), F.lit(dear[k]))
    return (tokens_in * of(0) + tokens_out * of(1)) / 1e6


def dated_cost(model: Column, tokens_in: Column, tokens_out: Column, day: Column, before: dict[str, tuple[float, float]], after: dict[str, tuple[float, float]], last_day: str) -> Column:
    """Cost at the prices of a day: some change after ``last_day``; an unknown model costs as the dearest ever does."""
    return F.when(day > F.lit(last_day).cast("date"), call_cost(model, tokens_in, tokens_out, before | after)).otherwise(call_cost(model, tokens_in, tokens_out, before))


def retry_delay(attempts: Column) -> Column:
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), F.least(attempts, F.lit(8)).cast("double")))
