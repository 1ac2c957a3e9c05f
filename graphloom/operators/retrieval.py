"""Ranked retrieval: keyword and vector arms, their fusion, graph boost, expansion, collapse and cap."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metadata import equals
from ..functions.scoring import SEARCH_WEIGHTS, cosine, cycle_recency, instant_recency, priority_boost, redistribute
from ..functions.temporal import live
from ..plans import fts

#: Fixed values of BM25 and of the pools.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
POOL, COLLAPSE_FACTOR = 50, 4
#: Half-lives, expansion, boost and cap of reflections.
HALF_LIFE, HALF_LIFE_S = 50.0, 604_800.0
EXPAND_TOP, EXPAND_EACH, EXPAND_CEILING, EXPAND_DECAY, REFLECTION_BOOST, REFLECTION_CAP = 5, 20, 50, 0.7, 1.0, 0.3


def ranked(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col("thought_id")).limit(k)


def bm25(thought: DataFrame, query: str | Sequence[str] | fts.Phrase | fts.Logic, eligible: Column | None = None) -> DataFrame:
    """(thought_id, score) of eligible rows that match; a list of words is any of them. Document counts and lengths are those of all rows.

    One scan counts the corpus, whose statistics are one row, and one scores. Both split only texts that
    contain a phrase's first word; no postings are shuffled.
    """
    tree = fts.parse(query)[0] if isinstance(query, str) else fts.any_of(query) if isinstance(query, list | tuple) else query
    found = fts.phrases(tree)
    if not found:
        return thought.limit(0).select("thought_id", F.lit(0.0).alias("score"))
    f = lambda i: F.get("__f", F.lit(i))
    all_ = thought.select(fts.length().alias("__dl"), fts.counts(found).alias("__f"))
    stats = all_.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *[F.count_if(f(i) > 0).alias(f"__df{i}") for i in range(len(found))])
    ok = F.lit(True) if eligible is None else eligible
    rows = thought.filter(ok & fts.possible(found)).select("thought_id", fts.length().alias("__dl"), fts.counts(found).alias("__f"))
    score = F.lit(0.0)
    for i in range(len(found)):
        df = F.col(f"__df{i}")
        idf = F.ln((F.col("__n") - df + 0.5) / (df + 0.5))
        score += F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)) * f(i) * (K1 + 1) / (f(i) + K1 * (1 - B + B * F.col("__dl") / F.col("__avg")))
    hit = fts.matched(tree, {p: f(i) > 0 for i, p in enumerate(found)})
    # A test of both sides stays above the join, where the counts are there; below it they would be made once more for each phrase.
    return rows.join(F.broadcast(stats)).filter(F.when(F.col("__n") > 0, hit).otherwise(False)).select("thought_id", score.alias("score"))


def knn(embedding: DataFrame, owners: DataFrame, vector: Sequence[float], threshold: float = 0.0) -> DataFrame:
    """(thought_id, score) of the owners' vectors with cosine of at least threshold; a query vector that is empty, zero or not finite finds nothing."""
    if not len(vector) or not all(map(math.isfinite, vector)) or not any(vector):
        return embedding.limit(0).select(F.col("owner_id").alias("thought_id"), F.lit(0.0).alias("score"))
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = embedding.select(F.col("owner_id").alias("thought_id"), cosine(F.col("vector"), q).alias("score"))
    return scored.join(owners.select("thought_id"), "thought_id", "left_semi").filter(F.col("score") >= threshold)


def search_similar(embedding: DataFrame, owners: DataFrame, vector: Sequence[float], top_k: int = 10, threshold: float = 0.0, dimension: int | None = None) -> DataFrame:
    """The top_k of knn. A vector of another length than the store's is an error, whatever its values."""
    if dimension is not None and len(vector) != dimension:
        raise ValueError(f"the store's vectors have {dimension} places, not {len(vector)}")
    return ranked(knn(embedding, owners, vector, threshold), top_k)


def search_text(thought: DataFrame, query: str, top_k: int = 10, eligible: Column | None = None) -> DataFrame:
    """The top_k of bm25 for a text, bare or expert."""
    return ranked(bm25(thought, query, eligible), top_k)


def minmax(df: DataFrame, score: str) -> DataFrame:
    """score scaled to 0..1 over all rows; 0.5 if all are equal. The rows are a pool, of bounded size: one window holds them."""
    lo, hi = F.min(score).over(W.partitionBy()), F.max(score).over(W.partitionBy())
    return df.withColumn(score, F.when(hi == lo, F.lit(0.5)).otherwise((F.col(score) - lo) / (hi - lo)))


def undirected(edge: DataFrame) -> DataFrame:
    one = edge.select("edge_id", F.col("from_thought_id").alias("thought_id"), F.col("to_thought_id").alias("other"), "weight")
    return one.unionByName(edge.select("edge_id", F.col("to_thought_id").alias("thought_id"), F.col("from_thought_id").alias("other"), "weight"))


def top_neighbours(edge: DataFrame, k: int) -> DataFrame:
    """Each record's k heaviest edges, in both directions."""
    w = W.partitionBy("thought_id").orderBy(F.col("weight").desc(), F.col("edge_id"), F.col("other"))
    return undirected(edge).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def settled(df: DataFrame, most: int) -> DataFrame:
    """df, of `most` rows at most, computed once: what follows reads it from the driver instead of scanning the store again."""
    return df.sparkSession.createDataFrame(df.limit(most).collect(), df.schema)


def fused(
    thought: DataFrame, embedding: DataFrame, edge: DataFrame, query: str | Sequence[str] | None, vector: Sequence[float] | None, *, recency: Column,
    weights: dict[str, float], eligible: Column, pool: int = POOL, decay: float = 0.5, edges_each: int = 5,
) -> DataFrame:
    """(thought_id, thought_type, metadata_json, fts, cos, near, score) of both arms' pools, with the weighted sum of the signals.

    Rows are filtered inside each arm, before its limit. An arm that isn't asked for has no weight; the others share it.
    """
    on = {k for k, v in weights.items() if v > 0} - ({"fts"} if query is None else set()) - ({"vector"} if vector is None else set())
    w = redistribute(weights, on)
    rows = thought.filter(eligible).select("thought_id", "thought_type", "metadata_json", "priority", "updated_cycle", "created_at", "updated_at")
    empty = thought.limit(0).select("thought_id", F.lit(0.0).alias("score"))
    text = empty if query is None else minmax(ranked(bm25(thought, query, eligible), pool), "score")
    near = empty if vector is None else ranked(knn(embedding, rows, vector), pool)
    both = text.withColumnRenamed("score", "fts").join(near.withColumnRenamed("score", "cos"), "thought_id", "full_outer")
    both = rows.join(F.broadcast(both), "thought_id").withColumn("recency", recency).withColumn("boost", priority_boost())
    both = settled(both, 2 * pool)
    base = F.greatest(F.coalesce("fts", F.lit(0.0)), F.coalesce("cos", F.lit(0.0)))
    if w.get("graph"):
        # Only edges of the pool's members count, so they are picked before they are ranked.
        member = F.broadcast(both.select("thought_id"))
        other = both.select(F.col("thought_id").alias("other"), base.alias("base"))
        order = W.partitionBy("thought_id").orderBy(F.col("weight").desc(), F.col("edge_id"), F.col("other"))
        own = undirected(edge).join(member, "thought_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= edges_each)
        sums = own.join(F.broadcast(other), "other").groupBy("thought_id").agg(F.sum(F.col("weight") * F.col("base") * decay).alias("near"))
        both = both.join(sums, "thought_id", "left")
    else:
        both = both.withColumn("near", F.lit(None).cast("double"))
    part = lambda name, c: F.lit(w.get(name, 0.0)) * F.coalesce(c, F.lit(0.0))
    score = part("fts", F.col("fts")) + part("vector", F.col("cos")) + part("recency", F.col("recency")) + part("priority", F.col("boost")) + part("graph", F.col("near"))
    return both.withColumn("score", score).drop("priority", "updated_cycle", "created_at", "updated_at", "boost", "recency")


def hybrid(
    thought: DataFrame, embedding: DataFrame, edge: DataFrame, query: str | Sequence[str], vector: Sequence[float], *, cycle: int, half_life: float = HALF_LIFE,
    top_k: int = 10, weights: dict[str, float] | None = None, eligible: Column | None = None, decay: float = 0.5, edges_each: int = 5,
) -> DataFrame:
    """(thought_id, score): the best rows of the fused pools, without expansion, collapse or cap."""
    ok = F.lit(True) if eligible is None else eligible
    found = fused(thought, embedding, edge, query, vector, recency=cycle_recency(cycle, half_life), weights=weights or SEARCH_WEIGHTS, eligible=ok, pool=max(POOL, top_k), decay=decay, edges_each=edges_each)
    return ranked(found.select("thought_id", "score"), top_k)


def expand(
    found: DataFrame, thought: DataFrame, edge: DataFrame, *, eligible: Column | None = None, reflections: int = EXPAND_TOP, each: int = EXPAND_EACH, ceiling: int = EXPAND_CEILING, decay: float = EXPAND_DECAY,
) -> DataFrame:
    """found with the sources of its best reflections: parent's score * decay * weight, the larger score where both exist.

    Sources must be eligible like what was found, so that none comes back that a filter left out.
    """
    kind = thought if eligible is None else thought.filter(eligible)
    parents = ranked(found.join(thought.filter("thought_type = 'REFLECTION'").select("thought_id"), "thought_id"), reflections)
    of = edge.filter("edge_type = 'CONSOLIDATED_FROM'").join(F.broadcast(parents.select(F.col("thought_id").alias("from_thought_id"), F.col("score").alias("parent"))), "from_thought_id")
    by = W.partitionBy("from_thought_id")
    kept = of.withColumn("n", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.col("weight").desc(), "edge_id"))).filter((F.col("n") <= ceiling) & (F.col("rank") <= each))
    more = kept.select(F.col("to_thought_id").alias("thought_id"), (F.col("parent") * decay * F.col("weight")).alias("score"))
    more = kind.filter("thought_type = 'OBSERVATION'").select("thought_id").join(F.broadcast(more), "thought_id")
    return found.select("thought_id", "score").unionByName(more).groupBy("thought_id").agg(F.max("score").alias("score"))


def collapse(found: DataFrame, unit: Column, most: int = 1) -> DataFrame:
    """At most `most` of the best rows of each unit; a row without a unit is its own."""
    if most < 1:
        raise ValueError("a unit keeps a row at least")
    key = F.coalesce(F.concat(F.lit("u"), unit), F.concat(F.lit("t"), F.col("thought_id")))
    w = W.partitionBy("__unit").orderBy(F.col("score").desc(), F.col("thought_id"))
    return found.withColumn("__unit", key).withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= most).drop("__unit", "__rank")


def unit_key(paths: str | Sequence[str], metadata: str = "metadata_json") -> Column:
    """A unit from one metadata path or several; null if any of them is missing or the metadata is malformed."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for path in paths:
        equals(metadata, path, None)  # raises on what is no path
    parts = [F.to_json(F.struct(F.try_variant_get(F.try_parse_json(metadata), p, "string").alias("v"))) for p in paths]
    there = [F.try_variant_get(F.try_parse_json(metadata), p, "string").isNotNull() for p in paths]
    out = F.concat_ws("|", *parts)
    for ok in there:
        out = F.when(ok, out)
    return out


def cap_reflections(found: DataFrame, top_k: int, share: float) -> DataFrame:
    """The top_k rows with at most top_k * share reflections; the next best others take the places of the rest.

    found (thought_id, score, thought_type) is a pool of bounded size.
    """
    w = W.partitionBy(F.col("thought_type") == "REFLECTION").orderBy(F.col("score").desc(), F.col("thought_id"))
    ranks = found.withColumn("__rank", F.row_number().over(w))
    return ranked(ranks.filter((F.col("thought_type") != "REFLECTION") | (F.col("__rank") <= int(top_k * share))).drop("__rank"), top_k)


@dataclass(frozen=True)
class SearchResult:
    """rows (rank, thought_id, score) in order; the parts of the search that had a say; how many reflections the cap took out."""

    rows: DataFrame
    backends_used: frozenset[str]
    reflections_evicted: int = 0


def search(
    thought: DataFrame, embedding: DataFrame, edge: DataFrame, query: str | Sequence[str] | None = None, vector: Sequence[float] | None = None, *, now: datetime, cycle: int | None = None,
    top_k: int = 10, weights: dict[str, float] | None = None, half_life: float = HALF_LIFE, recency_now: datetime | None = None, half_life_s: float = HALF_LIFE_S, filters: Column | None = None, include_archived: bool = False,
    include_reflections: bool = True, reflection_boost: float = REFLECTION_BOOST, reflection_cap: float = REFLECTION_CAP, expansion: bool = True,
    collapse_key: str | Sequence[str] | None = None, collapse_max: int | None = None, collapse_factor: int = COLLAPSE_FACTOR,
) -> SearchResult:
    """The whole ranked search, in this order: fusion, expansion, boost, reflections left out, collapse, cap, top_k.

    Recency counts cycles, or seconds where recency_now is given instead of cycle; both at once are an error,
    and so is a half-life that isn't positive where it counts. Without a query and a vector the latest rows
    come, with score 0 unless recency or priority has weight. filters add to what every arm and the expansion
    may return. A collapse key makes the arms' pools collapse_factor times as large.
    """
    weights = weights or SEARCH_WEIGHTS
    if cycle is not None and recency_now is not None:
        raise ValueError("recency counts cycles or seconds, not both")
    if collapse_max is not None and collapse_max < 1:
        raise ValueError("a unit keeps a row at least")
    timed = weights.get("recency", 0) > 0 and (cycle is not None or recency_now is not None)
    if timed and (half_life if cycle is not None else half_life_s) <= 0:
        raise ValueError("a half-life is positive")
    recency = F.lit(0.0) if not timed else cycle_recency(cycle, half_life) if cycle is not None else instant_recency(recency_now.isoformat(sep=" "), half_life_s)
    if not timed:
        weights = {**weights, "recency": 0.0}
    ok = live(now, include_archived) if filters is None else live(now, include_archived) & filters
    pool = max(POOL, top_k) * (collapse_factor if collapse_key is not None else 1)
    if query is None and vector is None:
        latest = F.col("updated_cycle").desc() if recency_now is None else F.coalesce("updated_at", "created_at").desc_nulls_last()
        kinds = ok if include_reflections else ok & (F.col("thought_type") != "REFLECTION")
        on = redistribute(weights, {k for k in ("recency", "priority") if weights.get(k, 0) > 0})
        score = F.lit(on.get("recency", 0.0)) * recency + F.lit(on.get("priority", 0.0)) * priority_boost()
        window = thought.filter(kinds).orderBy(latest, "thought_id").limit(top_k).select("thought_id", score.alias("score"))
        return SearchResult(_numbered(window), frozenset(k for k in on if on[k]))
    found = settled(fused(thought, embedding, edge, query, vector, recency=recency, weights=weights, eligible=ok, pool=pool), 2 * pool)
    told = found.agg(F.count("fts"), F.count("cos"), F.count_if(F.col("near") > 0)).first()
    used = {name for name, n in zip(("fts", "vector", "graph"), told, strict=True) if n and weights.get(name, 0) > 0}
    used |= {k for k in ("recency", "priority") if weights.get(k, 0) > 0}
    scores = found.select("thought_id", "score")
    if expansion:
        more = expand(scores, thought, edge, eligible=ok)
        more = settled(more, 2 * pool + EXPAND_TOP * EXPAND_EACH)
        before = scores.withColumnRenamed("score", "before")
        if more.join(before, "thought_id", "left").filter("before IS NULL OR score > before").limit(1).count():
            used.add("graph_expansion")
        scores = more
    rows = thought.select("thought_id", "thought_type", "metadata_json").join(F.broadcast(scores), "thought_id")
    is_reflection = F.col("thought_type") == "REFLECTION"
    rows = rows.withColumn("score", F.when(is_reflection, F.col("score") * reflection_boost).otherwise(F.col("score")))
    if not include_reflections:
        rows = rows.filter(~is_reflection)
    rows = settled(rows, 2 * pool + EXPAND_TOP * EXPAND_EACH)
    if collapse_key is not None:
        rows = collapse(rows, unit_key(collapse_key), collapse_max or 1)
    window = ranked(rows, top_k).filter(is_reflection).count()
    evicted = max(0, window - int(top_k * reflection_cap)) if reflection_cap < 1 else 0
    best = cap_reflections(rows, top_k, reflection_cap) if reflection_cap < 1 else ranked(rows, top_k)
    return SearchResult(_numbered(best.select("thought_id", "score")), frozenset(used), evicted)


def _numbered(best: DataFrame) -> DataFrame:
    """The rows of one answer with their rank: a window over top_k rows."""
    return best.select(F.row_number().over(W.orderBy(F.col("score").desc(), "thought_id")).alias("rank"), "thought_id", "score")


def recall(thought: DataFrame, embedding: DataFrame, edge: DataFrame, query: str, *, now: datetime, embed=None, top_k: int = 10, **more) -> SearchResult:
    """search for a text, with its vector by embed where there is one."""
    return search(thought, embedding, edge, query, None if embed is None else embed(query), now=now, top_k=top_k, **more)


def fallback(thought: DataFrame, eligible: Column, top_k: int) -> DataFrame:
    """The window of a search without a query: the latest rows, all with score 0."""
    return thought.filter(eligible).orderBy(F.col("updated_cycle").desc(), "thought_id").limit(top_k).select("thought_id", F.lit(0.0).alias("score"))


def reflections_only(thought: DataFrame, embedding: DataFrame, vector: Sequence[float], eligible: Column, cycle: int | None = None, recency_weight: float = 0.10, half_life: float = HALF_LIFE) -> DataFrame:
    """Active reflections by (1 - w) * cosine + w * recency, by cosine alone without a cycle; one without a vector has cosine 0."""
    rows = thought.filter(eligible & (F.col("thought_type") == "REFLECTION") & (F.col("lifecycle_status") == "ACTIVE"))
    cos = knn(embedding, rows, vector, threshold=-1.0).withColumnRenamed("score", "cos")
    cosine_ = F.coalesce("cos", F.lit(0.0))
    score = cosine_ if cycle is None else (1 - recency_weight) * cosine_ + recency_weight * cycle_recency(cycle, half_life)
    return rows.join(cos, "thought_id", "left").select("thought_id", score.alias("score"))
