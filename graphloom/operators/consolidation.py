"""Batch consolidation: score, gate, promote, link, cluster, judge, summarise, sweep."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import active_signals, cosine, redistribute, signals, weighted
from ..functions.text import entities, key_tokens, let, ngrams, truncated
from .graphs import components

#: Promotion weights, thresholds of the gates, limits of a run.
PROMOTION_WEIGHTS = {"recency": 0.25, "staleness": 0.20, "confirmation": 0.20, "confidence": 0.15, "frequency": 0.20, "action_outcome": 0.15}
MAX_PERSONA, MIN_COHESION, MIN_EXTERNAL, MIN_SHARED_ENTITIES, MIN_SIZE, MAX_SIZE = 0.75, 0.4, 0.95, 0.60, 3, 200
POOL, MIN_NEW_CANDIDATES, PHRASES, BOILERPLATE_SHARE, BOILERPLATE_CLUSTERS, BOILERPLATE_LEAST = 200, 50, 3, 0.30, 5, 1
#: What tells a description of a persona, and what a conversation's turn.
PERSONA, TURNS = ("born in 19", "born in 20", "is a ", "is the ", "is an ", "embracing their"), ("[USER]", "[ASSISTANT]", "[SYSTEM]")
#: Opposite words.
CONTRADICTIONS = (
    (("stopped", "quit", "abandoned", "dropped", "ended"), ("started", "began", "made", "created", "produced", "presented")),
    (("hate", "dislike", "disliked", "regret", "regretted", "annoying"), ("love", "loved", "enjoy", "enjoyed", "favorite", "favourite", "amazing")),
    (("can't", "couldn't", "unable", "incapable", "failed"), ("can", "could", "able", "succeeded", "managed")),
)
#: First words that make a phrase generic.
GENERIC_LEADERS = ("these", "those", "this", "that", "specific", "various", "certain", "some", "many", "few", "several", "their", "its", "other", "new", "old", "recent", "past", "future")
CONFIDENCE = {"low": 0, "medium": 1, "high": 2}


def candidates(thought: DataFrame, limit: int = POOL) -> DataFrame:
    """The pool of a run: active records, the latest updated first, ties by id."""
    return thought.filter("lifecycle_status = 'ACTIVE'").orderBy(F.col("updated_cycle").desc(), "thought_id").limit(limit)


def eligible(
    metadata: str = "metadata_json", *, perspectives: Sequence[str] | None = None, self_mode: str = "any", min_confidence: str = "low",
    excluded_types: Sequence[str] = ("code",), types: Sequence[str] | None = None,
) -> Column:
    """Whether a record's metadata lets it take part in consolidation.

    Records without metadata always may. Else a perspective or content type that is missing passes, one that
    is there must be allowed; is_self counts only as a boolean; a missing or unknown confidence is low.
    """
    doc = F.try_parse_json(metadata)
    at = lambda path: F.try_variant_get(doc, path, "string")
    is_string = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant")) == "STRING"
    out = F.lit(True)
    if perspectives is not None:
        out &= at("$.perspective").isNull() | at("$.perspective").isin(*perspectives)
    if self_mode != "any":
        is_self = F.when(F.schema_of_variant(F.try_variant_get(doc, "$.source.is_self", "variant")) == "BOOLEAN", at("$.source.is_self"))
        out &= ~F.coalesce(is_self == F.lit("true" if self_mode == "external_only" else "false"), F.lit(False))
    rank = F.lit(0)
    for name, value in CONFIDENCE.items():
        rank = F.when(is_string("$.source.confidence") & (at("$.source.confidence") == name), F.lit(value)).otherwise(rank)
    out &= rank >= CONFIDENCE[min_confidence]
    kind = at("$.content_type")
    out &= kind.isNull() | ~kind.isin(*excluded_types)
    if types is not None:
        out &= kind.isNull() | kind.isin(*types)
    return doc.isNull() | (F.regexp_replace(metadata, r"\s", "") == "{}") | F.coalesce(out, F.lit(False))


def promotion_weights(pool: DataFrame, cycle: int | None, weights: dict[str, float] | None = None, custom: Sequence[str] = (), access_tracking: bool = True) -> dict[str, float]:
    """Effective weights of a run: those of signals without a data source in the pool are shared out among the others; custom ones always count."""
    return redistribute(weights or PROMOTION_WEIGHTS, active_signals(pool, cycle, access_tracking) | set(custom))


def promotion_scores(pool: DataFrame, cycle: int, weights: dict[str, float] | None = None, custom: dict[str, tuple[Column, float]] | None = None) -> DataFrame:
    """pool with a score. custom adds signals of the caller's, each a Column from 0 to 1 and its weight."""
    custom = custom or {}
    all_ = (weights or PROMOTION_WEIGHTS) | {k: w for k, (_, w) in custom.items()}
    effective = promotion_weights(pool, cycle, all_, tuple(custom))
    return pool.withColumn("score", weighted(effective, signals(cycle) | {k: c for k, (c, _) in custom.items()}))


def p1_slots(thought: DataFrame, share: float = 0.05) -> int:
    """How many more records may be at P1: the share of all records, one at least, less those that are."""
    size = thought.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("priority") == "P1").cast("int")), F.lit(0)).alias("p1")).first()
    return max(0, max(1, int(size["n"] * share)) - size["p1"])


def promote(
    scored: DataFrame, cycle: int, slots: int, *, threshold: float = 0.7, min_age: int = 1, min_confirmations: int = 2, allow_zero: bool = True,
    most: int = 20, types: Sequence[str] = ("OBSERVATION",), may: Column | None = None,
) -> DataFrame:
    """(thought_id, score) of the rows that become P1: those that pass the gates, in pool order, up to the run's limit and the free slots."""
    gates = F.lit(cycle) - F.col("created_cycle") >= min_age
    if not allow_zero:
        gates &= F.col("confirmation_count") >= min_confirmations
    passed = gates & (eligible() if may is None else may) & (F.col("score") > threshold) & (F.col("priority") != "P1") & F.col("thought_type").isin(*types)
    return scored.filter(passed).orderBy(F.col("updated_cycle").desc(), "thought_id").limit(min(most, slots)).select("thought_id", "score")


def should_cluster(thought: DataFrame, last: int | None, min_new: int = MIN_NEW_CANDIDATES, types: Sequence[str] = ("OBSERVATION",)) -> tuple[bool, int]:
    """(whether clustering runs, the count to keep for the next run): it is skipped while fewer than min_new candidates are new since the last."""
    count = thought.filter((F.col("lifecycle_status") == "ACTIVE") & F.col("thought_type").isin(*types)).count()
    runs = not min_new or last is None or count - last >= min_new
    return runs, count if runs else last


def cluster_pool(thought: DataFrame, types: Sequence[str] = ("OBSERVATION",), limit: int = POOL) -> DataFrame:
    """The union of each admissible type's candidates, a pool of bounded size."""
    pools = [candidates(thought.filter(F.col("thought_type") == t), limit) for t in dict.fromkeys(types)]
    return reduce(DataFrame.unionByName, pools)


def similar_pairs(embedding: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """(a, b, sim) of a candidate pool's vectors with cosine of at least threshold, a before b.

    Vectors are dealt into blocks of about `block`, and each pair of blocks is one matrix product in one task.
    """
    v = embedding.select(F.col("owner_id").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, -(-v.count() // block))
    own = v.withColumn("own", F.pmod(F.hash("id"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = own.select("id", "vector", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def product(key: tuple, part: pa.Table) -> pa.Table:
        ids, mine = np.array(part.column("id").to_pylist(), object), part.column("own").to_numpy()
        x = np.array(part.column("vector").to_pylist(), np.float64).reshape(len(ids), -1)
        norm = np.linalg.norm(x, axis=1)
        x = x / np.where(norm > 0, norm, 1)[:, None]
        lo, hi = np.flatnonzero(mine == key[0].as_py()), np.flatnonzero(mine == key[1].as_py())
        sim = x[lo] @ x[hi].T
        i, j = np.nonzero(sim >= threshold)
        sim, i, j = sim[i, j], ids[lo[i]], ids[hi[j]]
        keep = i != j if key[0].as_py() != key[1].as_py() else i < j
        a, b = np.where(i < j, i, j)[keep], np.where(i < j, j, i)[keep]
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "sim": pa.array(sim[keep])})

    return dealt.groupBy("lo", "hi").applyInArrow(product, "a string, b string, sim double")


def new_neighbours(pairs: DataFrame, edge: DataFrame, k: int) -> DataFrame:
    """Each record's k nearest others that no edge joins to it yet, with the weight of the edge to make."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    known = edge.select(F.col("from_thought_id").alias("a"), F.col("to_thought_id").alias("b"))
    known = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    w = W.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    fresh = both.join(known, ["a", "b"], "left_anti").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return fresh.select(F.col("a").alias("from_thought_id"), F.col("b").alias("to_thought_id"), F.least(F.lit(1.0), F.col("sim") * 0.5).alias("weight"))


def clusters(pairs: DataFrame, least: int = MIN_SIZE, most: int = MAX_SIZE) -> DataFrame:
    """(thought_id, cluster_id) of single-linkage clusters of admissible size; a cluster has its smallest id."""
    member = components(pairs)
    sizes = member.groupBy("cluster_id").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("n") <= most))
    return member.join(sizes.select("cluster_id"), "cluster_id").select("thought_id", "cluster_id")


def centroids(member: DataFrame, embedding: DataFrame) -> DataFrame:
    """(cluster_id, pos, value): the unit-length mean of each cluster's vectors, by place."""
    at = member.join(embedding.select(F.col("owner_id").alias("thought_id"), "vector"), "thought_id").select("cluster_id", F.posexplode("vector").alias("pos", "x"))
    mean = at.groupBy("cluster_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))
    norm = mean.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return mean.join(norm, "cluster_id").select("cluster_id", "pos", F.when(F.col("norm") > 0, F.col("value") / F.col("norm")).otherwise(F.lit(0.0)).alias("value"))


def cohesion(member: DataFrame, embedding: DataFrame) -> DataFrame:
    """(cluster_id, cohesion): mean cosine of a cluster's pairs, 1 for a single member. Clusters have at most MAX_SIZE members."""
    v = member.join(embedding.select(F.col("owner_id").alias("thought_id"), "vector"), "thought_id")
    a = v.select("cluster_id", F.col("thought_id").alias("a"), F.col("vector").alias("va"))
    b = v.select("cluster_id", F.col("thought_id").alias("b"), F.col("vector").alias("vb"))
    pairs = a.join(b, "cluster_id").filter("a < b").groupBy("cluster_id").agg(F.avg(cosine(F.col("va"), F.col("vb"))).alias("cohesion"))
    return member.select("cluster_id").distinct().join(pairs, "cluster_id", "left").fillna(1.0, ["cohesion"])


def contradictions(text: Column) -> list[Column]:
    """Whether a text has words of each side of each pair of opposites; a word ends where no letter, digit or underscore follows."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z']+\b"), 0)
    return [F.arrays_overlap(words, F.array(*map(F.lit, side))) for pair in CONTRADICTIONS for side in pair]


def gates(member: DataFrame, thought: DataFrame, cohesive: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """(cluster_id, rejected_by): the first gate that a cluster fails, or null.

    Gates in order: equal contents, descriptions of a persona, opposite words, low cohesion, records of the
    agent's own, entities that aren't shared with the first member, and, with phrases (cluster_id, phrase),
    generic phrases only. A record is the agent's own only if its metadata says so by a boolean at
    source.is_self. One shuffle by cluster serves all gates; clusters have a bounded number of members.
    """
    rows = member.join(thought.select("thought_id", "content", "content_hash", "metadata_json"), "thought_id")
    has = lambda text, parts: reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in parts])
    persona = ~has(F.col("content"), TURNS) & has(F.lower("content"), PERSONA)
    is_self = F.from_json("metadata_json", "source struct<is_self: boolean>")["source"]["is_self"]
    sides = contradictions(F.col("content"))
    told = rows.select(
        "cluster_id", "thought_id", "content_hash", persona.cast("double").alias("persona"), F.when(is_self, 0.0).otherwise(1.0).alias("external"),
        *[c.alias(f"s{i}") for i, c in enumerate(sides)], entities(F.col("content")).alias("names"),
    )
    one = told.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.count_distinct("content_hash").alias("distinct"), F.avg("persona").alias("persona"), F.avg("external").alias("external"),
        *[F.bool_or(f"s{i}").alias(f"s{i}") for i in range(len(sides))], F.min_by("names", "thought_id").alias("first"), F.collect_list("names").alias("all"),
    )
    clash = reduce(lambda a, b: a | b, [F.col(f"s{i}") & F.col(f"s{i + 1}") for i in range(0, len(sides), 2)])
    shared = F.size(F.filter("all", lambda x: F.arrays_overlap(x, F.col("first")))) / F.col("n")
    out = one.join(cohesive, "cluster_id")
    first = (
        F.when(F.col("distinct") < F.col("n"), "duplicate").when(F.col("persona") >= MAX_PERSONA, "persona").when(clash, "contradiction")
        .when(F.col("cohesion") < MIN_COHESION, "cohesion").when(F.col("external") < MIN_EXTERNAL, "external")
        .when((F.size("first") > 0) & (shared < MIN_SHARED_ENTITIES), "entities")
    )
    if phrases is not None:
        meaningful = phrases.filter(~generic(F.col("phrase"))).select("cluster_id", F.lit(True).alias("meaningful")).distinct()
        out = out.join(meaningful, "cluster_id", "left")
        first = first.when(F.col("meaningful").isNull(), "generic")
    return out.select("cluster_id", first.alias("rejected_by"))


def generic(phrase: Column) -> Column:
    """Whether a phrase starts with a determiner or vague quantifier that another word follows."""
    return F.coalesce(phrase.rlike(rf"(?i)^\s*(?:{'|'.join(GENERIC_LEADERS)})\s+[\p{{L}}\p{{N}}_]"), F.lit(True))


def keywords(rows: DataFrame, top: int, order: str = "thought_id") -> DataFrame:
    """(cluster_id, word, n): each cluster's most frequent words; ties go to the word seen first, members in order of their id."""
    word = rows.select("cluster_id", order, F.posexplode(key_tokens(F.col("content"))).alias("pos", "word"))
    w = W.partitionBy("cluster_id").orderBy(F.col("n").desc(), "first")
    count = word.groupBy("cluster_id", "word").agg(F.count("*").alias("n"), F.min(F.struct(order, "pos")).alias("first"))
    return count.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("cluster_id", "word", "n")


def tfidf(rows: DataFrame, corpus: DataFrame, top: int = PHRASES) -> DataFrame:
    """(cluster_id, phrase, score): each cluster's best phrases of two and three words, by tf * ln((1 + N) / (1 + df)) to four places.

    tf counts over a cluster's members, df over the corpus, a record a row, N is the corpus' size.
    """
    words = key_tokens(F.col("content"))
    grams = let(words, lambda w: F.concat(ngrams(w, 2), ngrams(w, 3)))
    tf = rows.select("cluster_id", F.explode(grams).alias("phrase")).groupBy("cluster_id", "phrase").agg(F.count("*").alias("tf"))
    # A record counts once for a phrase, so partial sums of records meet.
    df = corpus.select(F.explode(F.array_distinct(grams)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("df"))
    total = corpus.agg(F.count("*").alias("N"))
    scored = tf.join(df, "phrase", "left").join(F.broadcast(total)).withColumn("exact", F.col("tf") * F.ln((1 + F.col("N")) / (1 + F.coalesce("df", F.lit(0)))))
    w = W.partitionBy("cluster_id").orderBy(F.col("exact").desc(), "phrase")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("cluster_id", "phrase", F.round("exact", 4).alias("score"))


def phrase_frequency(phrases: DataFrame) -> DataFrame:
    """(phrase, clusters): in how many clusters' lists each phrase stands, in lower case."""
    return phrases.groupBy(F.lower("phrase").alias("phrase")).agg(F.count_distinct("cluster_id").alias("clusters"))


def without_boilerplate(phrases: DataFrame, total_clusters: int, share: float = BOILERPLATE_SHARE, min_clusters: int = BOILERPLATE_CLUSTERS, least: int = BOILERPLATE_LEAST) -> DataFrame:
    """phrases (cluster_id, phrase, score) less those in over `share` of all clusters; a cluster left with fewer than `least` keeps its list.

    With fewer than min_clusters clusters nothing goes.
    """
    if total_clusters < min_clusters:
        return phrases
    common = phrase_frequency(phrases).filter(F.col("clusters") / F.lit(total_clusters) > share).select(F.col("phrase").alias("__common"))
    told = phrases.join(common, F.lower("phrase") == F.col("__common"), "left").withColumn("__good", F.col("__common").isNull())
    kept = F.sum(F.col("__good").cast("int")).over(W.partitionBy("cluster_id"))
    return told.withColumn("__kept", kept).filter(F.col("__good") | (F.col("__kept") < least)).select(*phrases.columns)


def summaries(member: DataFrame, thought: DataFrame, excerpts: int = 5, excerpt_chars: int = 150) -> DataFrame:
    """What a reflection says of each cluster: members, hash of its sources, span, valid extent, best priority, entities, first excerpts.

    Excerpts are of the members by priority, then the latest first, those without a date before all others.
    """
    rows = member.join(thought.select("thought_id", "content", "priority", "created_at", "valid_from", "valid_until"), "thought_id")
    from_ = F.when(F.count("*") > F.count("valid_from"), F.lit(None)).otherwise(F.min("valid_from"))
    until = F.when(F.count("*") > F.count("valid_until"), F.lit(None)).otherwise(F.max("valid_until"))
    ids = F.array_sort(F.collect_list("thought_id"))
    late = F.when(F.col("created_at").isNotNull(), -F.unix_micros(F.col("created_at").cast("timestamp")))
    order = F.struct("priority", late.alias("late"), "thought_id", truncated(F.col("content"), excerpt_chars).alias("excerpt"))
    first = F.slice(F.array_sort(F.collect_list(order), lambda a, b: _first(a, b)), 1, excerpts)
    out = rows.groupBy("cluster_id").agg(
        F.count("*").alias("members"), ids.alias("member_ids"), F.substring(F.sha2(F.concat(F.lit('["'), F.array_join(ids, '", "'), F.lit('"]')), 256), 1, 16).alias("source_hash"), F.min("priority").alias("priority"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), from_.alias("valid_from"), until.alias("valid_until"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(entities(F.col("content")))))).alias("entities"), F.transform(first, lambda x: F.struct(x["thought_id"].alias("thought_id"), x["excerpt"].alias("excerpt"))).alias("excerpts"),
    )
    span = (F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 86_400_000_000
    return out.withColumn("span_days", F.coalesce(F.round(span, 2), F.lit(0.0)))


def _first(a: Column, b: Column) -> Column:
    """The order of excerpts as a comparison: priority, then no date, then the latest, then the id."""
    key = lambda x: F.struct(x["priority"], x["late"].isNotNull(), F.coalesce(x["late"], F.lit(0)), x["thought_id"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def reflections(summary: DataFrame, words: DataFrame, phrases: DataFrame, existing: DataFrame, cycle: int, now: datetime, priority: str = "P2") -> DataFrame:
    """One new record per cluster that has none yet: its id follows from its sources' hash, its content is JSON of what is known of it.

    summary as of summaries, words as of keywords, phrases as of without_boilerplate; existing are the records that there are.
    """
    word = words.withColumn("rank", F.struct((-F.col("n")).alias("less"), "word")).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list("rank")), lambda x: x["word"]).alias("keywords"))
    phrase = phrases.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "phrase", "score"))).alias("found"))
    phrase = phrase.select("cluster_id", F.transform("found", lambda x: F.struct(x["phrase"].alias("phrase"), x["score"].alias("score"))).alias("top_keyphrases"))
    source = F.concat(F.lit("dreaming:"), F.col("source_hash"))
    known = existing.filter("thought_type = 'REFLECTION'").select(F.col("source").alias("__source"))
    rows = summary.join(known, source == F.col("__source"), "left_anti").join(word, "cluster_id", "left").join(phrase, "cluster_id", "left")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    none = F.lit("1970-01-01T00:00:00+00:00")
    content = F.to_json(F.struct(
        F.lit("reflection").alias("type"), F.lit(2).alias("version"), "member_ids", F.coalesce("keywords", F.array()).alias("keywords"), F.col("source_hash").alias("cluster_hash"),
        F.col("members").alias("member_count"), F.lit("agglomerative").alias("cluster_algorithm"), F.lit(now.isoformat() + "+00:00").alias("created_at"), "top_keyphrases", F.col("excerpts").alias("member_excerpts"),
        F.struct(F.coalesce(stamp("first_at"), none).alias("min_created_at"), F.coalesce(stamp("last_at"), none).alias("max_created_at"), "span_days").alias("temporal_span"), F.col("entities").alias("named_entities"),
    ))
    essence = F.substring(F.concat(F.lit("REFLECTION ["), F.array_join(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 3), ", "), F.lit("]")), 1, 200)
    return rows.select(
        F.concat(F.lit("r"), F.col("source_hash")).alias("thought_id"), F.lit("REFLECTION").alias("thought_type"), essence.alias("essence"), content.alias("content"), F.lit(priority).alias("priority"),
        F.lit("ACTIVE").alias("lifecycle_status"), F.lit(cycle).cast("long").alias("created_cycle"), F.lit(cycle).cast("long").alias("updated_cycle"), source.alias("source"),
        F.lit("DREAMING").alias("source_type"), "valid_from", "valid_until", "member_ids",
    )


def lineage(reflection: DataFrame, cycle: int) -> DataFrame:
    """The CONSOLIDATED_FROM edges of reflections to their members, all of weight 1."""
    pairs = reflection.select("thought_id", F.explode("member_ids").alias("to"))
    return pairs.select(
        F.concat("thought_id", F.lit(">"), "to").alias("edge_id"), F.col("thought_id").alias("from_thought_id"), F.col("to").alias("to_thought_id"), F.lit("CONSOLIDATED_FROM").alias("edge_type"),
        F.lit(1.0).alias("weight"), F.lit(cycle).cast("long").alias("created_cycle"), F.lit("DREAMING").alias("source"),
    )


def counters(scored: DataFrame, promoted: DataFrame, edges: DataFrame, reflection: DataFrame, retired: DataFrame, thought: DataFrame, cycle: int, min_age: int = 1) -> DataFrame:
    """One row that tells what a run did."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    told = scored.agg(F.count("*").alias("candidates_evaluated"), F.coalesce(F.sum((F.lit(cycle) - F.col("created_cycle") < min_age).cast("long")), F.lit(0)).alias("skipped_gate_count"))
    all_ = thought.agg(F.count("*").alias("__n"), F.coalesce(F.sum((F.col("priority") == "P1").cast("long")), F.lit(0)).alias("__p1"))
    for df, name in ((promoted, "promoted_count"), (edges, "edges_created"), (reflection, "reflections_created"), (retired, "orphans_retired")):
        told = told.crossJoin(one(df, name))
    share = F.when(F.col("__n") > 0, (F.col("__p1") + F.col("promoted_count")) / F.col("__n")).otherwise(0.0)
    return told.crossJoin(all_).withColumn("p1_fraction_after", share).drop("__n", "__p1")


def orphans(thought: DataFrame, edge: DataFrame) -> DataFrame:
    """Active reflections none of whose sources is active, or without sources if consolidation made them."""
    refl = thought.filter("thought_type = 'REFLECTION' AND lifecycle_status = 'ACTIVE'").select("thought_id", "source_type")
    of = edge.filter("edge_type = 'CONSOLIDATED_FROM'").select(F.col("from_thought_id").alias("thought_id"), "to_thought_id")
    states = of.join(thought.select(F.col("thought_id").alias("to_thought_id"), "lifecycle_status"), "to_thought_id").groupBy("thought_id").agg(F.bool_or(F.col("lifecycle_status") == "ACTIVE").alias("alive"))
    return refl.join(states, "thought_id", "left").filter("alive = false OR (alive IS NULL AND source_type = 'DREAMING')").select("thought_id")
