"""Batch eviction: keep scores, protection, archiving, collection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import KEEP_WEIGHTS, active_signals, redistribute, signals, weighted

#: Archive below this score, after this idle time, so many a run; windows before collection.
THRESHOLD, MIN_IDLE_S, CAP, GC_CYCLES, GC_SECONDS, PROTECTED = 0.20, 604_800, 100, 10, 2_592_000, ("P1",)


def _age_s(now: datetime, at: Column) -> Column:
    return F.unix_seconds(F.lit(now.isoformat(sep=" ")).cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))


def keep_scores(thought: DataFrame, cycle: int, now: datetime, custom: dict[str, tuple[Column, float]] | None = None, access_tracking: bool = True) -> DataFrame:
    """Unexpired active or created rows with their keep score, and whether any of them shows that it was used.

    custom adds signals of the caller's, each a Column and its weight; they count as active.
    """
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    pool = thought.filter((F.col("expires_at").isNull() | (F.col("expires_at") > at)) & F.col("lifecycle_status").isin("ACTIVE", "CREATED"))
    custom = custom or {}
    active = active_signals(pool, cycle, access_tracking)
    weights = redistribute(KEEP_WEIGHTS | {k: w for k, (_, w) in custom.items()}, active | set(custom))
    used = bool(active & {"frequency", "confirmation", "action_outcome"})
    return pool.withColumn("keep_score", weighted(weights, signals(cycle) | {k: c for k, (c, _) in custom.items()})).withColumn("used", F.lit(used))


def protection(now: datetime, protected: Sequence[str] = PROTECTED, min_idle: int = MIN_IDLE_S) -> Column:
    """Why a row may not be archived, or null: pinned, priority, recent. A row without any timestamp counts as recent."""
    idle = _age_s(now, F.coalesce("last_accessed_at", "updated_at", "created_at"))
    return F.when(F.col("pinned"), "pinned").when(F.col("priority").isin(*protected), "priority").when(F.coalesce(idle, F.lit(-1)) < min_idle, "recent")


def reviewed(scored: DataFrame, now: datetime, threshold: float = THRESHOLD, cap: int = CAP, decay: Column | None = None) -> DataFrame:
    """A dry run: (thought_id, eviction_score, outcome) of every row of keep_scores, outcome archive or why not.

    decay multiplies the score, from 0 to 1; null and what is no number count as 1. Reasons: pinned, priority,
    recent, unused (no row of the pool shows that it was used), kept (its score is high enough), cap.
    """
    multiplier = F.lit(1.0) if decay is None else F.when(decay.isNull() | F.isnan(decay) | (F.abs(decay) == float("inf")), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), decay)))
    score = F.col("keep_score") * multiplier
    why = F.coalesce(protection(now), F.when(~F.col("used"), "unused"), F.when(score >= threshold, "kept"))
    told = scored.select("thought_id", score.alias("eviction_score"), why.alias("why"), "created_at")
    low = told.filter("why IS NULL").orderBy("eviction_score", F.col("created_at").asc_nulls_first(), "thought_id").limit(cap)
    first = low.select("thought_id", F.lit("archive").alias("first"))
    return told.join(F.broadcast(first), "thought_id", "left").select("thought_id", "eviction_score", F.coalesce("why", "first", F.lit("cap")).alias("outcome"))


def to_archive(scored: DataFrame, now: datetime, threshold: float = THRESHOLD, cap: int = CAP, decay: Column | None = None) -> DataFrame:
    """(thought_id, eviction_score) of the rows to archive, at most cap: the lowest score first, then the oldest, then the smallest id."""
    return reviewed(scored, now, threshold, cap, decay).filter("outcome = 'archive'").select("thought_id", "eviction_score")


def archived(thought: DataFrame, chosen: DataFrame, cycle: int, now: datetime) -> DataFrame:
    """thought with the chosen rows (thought_id, at most a run's cap) archived: status and both stamps set, expiry cleared, revision raised."""
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    rows = thought.join(F.broadcast(chosen.select("thought_id", F.lit(True).alias("__hit"))), "thought_id", "left")
    to = {"lifecycle_status": F.lit("ARCHIVED"), "archived_at_cycle": F.lit(cycle).cast("long"), "archived_at": at, "expires_at": F.lit(None), "revision": F.col("revision") + 1}
    return rows.select(*[(F.when(F.col("__hit"), to[c]).otherwise(F.col(c)).alias(c) if c in to else F.col(c)) for c in thought.columns])


def to_collect(thought: DataFrame, cycle: int, now: datetime) -> DataFrame:
    """Archived rows that are out of both windows and unprotected; a missing stamp keeps a row. delete() takes what hangs on them too."""
    old = (F.lit(cycle) - F.col("archived_at_cycle") >= GC_CYCLES) & (_age_s(now, F.col("archived_at")) >= GC_SECONDS)
    return thought.filter((F.col("lifecycle_status") == "ARCHIVED") & ~F.col("pinned") & (F.col("priority") != "P1") & F.coalesce(old, F.lit(False))).select("thought_id")
