"""Plain reads of a store: lists, counts, edges of a record, and what a store's metrics tell."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A hook on the way in or out: it sees rows and returns them, enriched; rows it drops are lost to the caller only.
Hook = Callable[[DataFrame], DataFrame]


def unexpired(now: datetime) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz"))


def get_thought(thought: DataFrame, thought_id: str, on_retrieve: Hook | None = None) -> DataFrame:
    found = thought.filter(F.col("thought_id") == thought_id)
    return found if on_retrieve is None else on_retrieve(found)


def _some(thought: DataFrame, now: datetime, include_expired: bool, **equal: str | None) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            thought = thought.filter(F.col(name) == value)
    return thought if include_expired else thought.filter(unexpired(now))


def list_thoughts(
    thought: DataFrame, now: datetime, *, priority: str | None = None, lifecycle_status: str | None = None, thought_type: str | None = None, min_cycle: int | None = None, max_cycle: int | None = None,
    visibility: str | None = None, exclude_visibility: str | None = None, include_expired: bool = False, provenance: Column | None = None, limit: int = 50, offset: int = 0, on_retrieve: Hook | None = None,
) -> DataFrame:
    """The latest updated records that pass every filter given; archived ones are listed, expired ones aren't. Ties go to the smaller id.

    provenance is a predicate as of functions.metadata.matches. A record without visibility isn't an excluded one.
    """
    rows = _some(thought, now, include_expired, priority=priority, lifecycle_status=lifecycle_status, thought_type=thought_type, visibility=visibility)
    if min_cycle is not None:
        rows = rows.filter(F.col("updated_cycle") >= min_cycle)
    if max_cycle is not None:
        rows = rows.filter(F.col("updated_cycle") <= max_cycle)
    if exclude_visibility is not None:
        rows = rows.filter(~F.col("visibility").eqNullSafe(exclude_visibility))
    if provenance is not None:
        rows = rows.filter(provenance)
    rows = rows.orderBy(F.col("updated_cycle").desc(), "thought_id").offset(offset).limit(limit)
    return rows if on_retrieve is None else on_retrieve(rows)


def count_thoughts(thought: DataFrame, now: datetime, *, thought_type: str | None = None, lifecycle_status: str | None = None, priority: str | None = None, include_expired: bool = False) -> DataFrame:
    return _some(thought, now, include_expired, thought_type=thought_type, lifecycle_status=lifecycle_status, priority=priority).agg(F.count("*").alias("count"))


def get_edges(edge: DataFrame, thought_id: str, direction: str = "BOTH", limit: int | None = None) -> DataFrame:
    """A record's edges that go out, come in or both, the heaviest first; a limit keeps those."""
    ends = {"OUT": F.col("from_thought_id") == thought_id, "IN": F.col("to_thought_id") == thought_id}
    if direction not in (*ends, "BOTH"):
        raise ValueError("a direction is IN, OUT or BOTH")
    found = edge.filter(ends["OUT"] | ends["IN"] if direction == "BOTH" else ends[direction]).orderBy(F.col("weight").desc(), "edge_id")
    return found if limit is None else found.limit(limit)


def list_edges(edge: DataFrame, edge_type: str | None = None, source: str | None = None, filters: Column | None = None, limit: int = 5000) -> DataFrame:
    """Edges, the latest made first."""
    for name, value in (("edge_type", edge_type), ("source", source)):
        if value is not None:
            edge = edge.filter(F.col(name) == value)
    if filters is not None:
        edge = edge.filter(filters)
    return edge.orderBy(F.col("created_cycle").desc(), "edge_id").limit(limit)


def get_embedding(embedding: DataFrame, owner_id: str) -> DataFrame:
    return embedding.filter(F.col("owner_id") == owner_id)


def get_actions(action: DataFrame, thought_id: str) -> DataFrame:
    return action.filter(F.col("source_thought_id") == thought_id)


def counts(thought: DataFrame, edge: DataFrame) -> DataFrame:
    """(kind, type, status, n): records by type and status with subtotals, edges by type, and totals, where the rest is null."""
    by = thought.rollup("thought_type", "lifecycle_status").agg(F.count("*").alias("n"))
    edges = edge.rollup("edge_type").agg(F.count("*").alias("n"))
    return by.select(F.lit("thought").alias("kind"), F.col("thought_type").alias("type"), F.col("lifecycle_status").alias("status"), "n").unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("edge_type").alias("type"), F.lit(None).cast("string").alias("status"), "n")
    )


def latency(samples: DataFrame, value: str, order: str, window: int = 1000) -> DataFrame:
    """Percentiles, extremes and mean of the last `window` samples."""
    last = samples.orderBy(F.col(order).desc()).limit(window)
    p = lambda q: F.percentile(value, F.lit(q))
    return last.agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def max_cycle(thought: DataFrame, edge: DataFrame) -> DataFrame:
    """The highest cycle that a record was updated or an edge made in; 0 in an empty store."""
    both = thought.agg(F.max("updated_cycle").alias("c")).unionByName(edge.agg(F.max("created_cycle").alias("c")))
    return both.agg(F.coalesce(F.max("c"), F.lit(0)).alias("max_cycle"))
