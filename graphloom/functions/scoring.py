"""Scores of single rows: similarity, recency, priority and the consolidation signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Priority boosts, weights of the search and of the keep score.
PRIORITY = {"P1": 1.0, "P2": 0.6, "P3": 0.3, "P4": 0.0}
SEARCH_WEIGHTS = {"fts": 0.30, "vector": 0.55, "recency": 0.10, "priority": 0.05, "graph": 0.00}
KEEP_WEIGHTS = {"recency": 0.30, "frequency": 0.25, "confirmation": 0.20, "confidence": 0.15, "staleness": 0.10}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def cycle_recency(cycle: int, half_life: float, updated: Column | None = None) -> Column:
    age = F.greatest(F.lit(0), F.lit(cycle) - (F.col("updated_cycle") if updated is None else updated))
    return F.exp(F.lit(-math.log(2)) * age / F.lit(float(half_life)))


def instant_recency(now: str, half_life_s: float) -> Column:
    """The same law over seconds since the last update, else creation; rows without either get 0."""
    at = F.coalesce("updated_at", "created_at")
    age = F.greatest(F.lit(0), F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(at.cast("timestamp")))
    return F.coalesce(F.exp(F.lit(-math.log(2)) * age / F.lit(float(half_life_s))), F.lit(0.0))


def priority_boost() -> Column:
    out = F.lit(0.0)
    for p, v in PRIORITY.items():
        out = F.when(F.col("priority") == p, F.lit(v)).otherwise(out)
    return out


def signals(cycle: int) -> dict[str, Column]:
    """The consolidation signals, each from 0 to 1. Their recency has a fixed rate, not a half-life."""
    age = F.greatest(F.lit(0), F.lit(cycle) - F.col("updated_cycle"))
    return {
        "recency": F.exp(F.lit(-0.01) * age),
        "staleness": F.least(F.lit(1.0), (F.col("updated_cycle") - F.col("created_cycle")) / F.lit(100.0)),
        "confirmation": F.least(F.lit(1.0), F.col("confirmation_count") / F.lit(5.0)),
        "confidence": F.coalesce("confidence", F.lit(0.5)),
        "frequency": F.least(F.lit(1.0), F.col("access_count") / F.lit(10.0)),
        "action_outcome": F.coalesce("action_outcome_score", F.lit(0.0)),
    }


def active_signals(pool: DataFrame, cycle: int | None, access_tracking: bool = True) -> set[str]:
    """The signals that have a data source in the pool: a run has a cycle, or some row a value that is no default. One job, one row."""
    told = pool.agg(
        F.bool_or(F.col("confirmation_count") > 0).alias("confirmation"), F.bool_or(F.col("confidence").isNotNull()).alias("confidence"),
        F.bool_or(F.col("access_count") > 0).alias("frequency"), F.bool_or(F.col("action_outcome_score").isNotNull()).alias("action_outcome"),
    ).first().asDict()
    found = {name for name, shown in told.items() if shown and (name != "frequency" or access_tracking)}
    return found if cycle is None else found | {"recency", "staleness"}


def weighted(weights: dict[str, float], values: dict[str, Column]) -> Column:
    """The sum of the values by weight."""
    total = F.lit(0.0)
    for name, w in weights.items():
        if w:
            total += F.lit(w) * values[name]
    return total


def redistribute(weights: dict[str, float], active: set[str]) -> dict[str, float]:
    """Weights of the active signals, in proportion, as shares of 1; all 0 if none has weight."""
    total = sum(w for k, w in weights.items() if k in active)
    return {k: (w / total if k in active and total > 0 else 0.0) for k, w in weights.items()}
