"""Writes as functions of DataFrames: deduplication, upsert, invalidation, cascades, expiry, journal."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dedupe(thought: DataFrame) -> DataFrame:
    """One row per content hash, the first id; each further copy confirms it once more. Partial sums meet, not rows."""
    return thought.groupBy("content_hash").agg(F.min("thought_id").alias("thought_id"), (F.min_by("confirmation_count", "thought_id") + F.count("*") - 1).alias("confirmation_count"))


def get_or_create(thought: DataFrame, new: DataFrame, order: str = "thought_id") -> DataFrame:
    """(content_hash, thought_id, created) of each new row: the known record of its hash, else the first new one, which alone is created."""
    known = thought.groupBy("content_hash").agg(F.min("thought_id").alias("known"))
    first = new.groupBy("content_hash").agg(F.min_by("thought_id", order).alias("first"))
    told = new.select("content_hash", F.col("thought_id").alias("own")).join(first, "content_hash").join(known, "content_hash", "left")
    created = F.col("known").isNull() & (F.col("own") == F.col("first"))
    return told.select("content_hash", F.coalesce("known", "first").alias("thought_id"), created.alias("created"))


#: The fields that an upsert overwrites, and what a record has where the caller says nothing.
MUTABLE = ("essence", "priority", "metadata_json", "visibility", "lifecycle_status", "source", "confidence", "source_type", "thought_type")
DEFAULTS = {"thought_type": "NOTE", "priority": "P3", "lifecycle_status": "ACTIVE", "visibility": "public", "source_type": "EXPERIENCE"}


def upsert(thought: DataFrame, new: DataFrame, columns: Sequence[str] = MUTABLE) -> DataFrame:
    """thought with columns from new where new has the same content hash, and new's other rows; every other column stays as it is.

    Of new rows with one hash the last, by id, wins; of known rows with one hash the first is changed. The ids of
    new's rows are new; create() tells those that aren't.
    """
    latest = new.withColumn("__n", F.row_number().over(W.partitionBy("content_hash").orderBy(F.col("thought_id").desc()))).filter("__n = 1").drop("__n")
    fresh = latest.select(*[F.col(c).alias(f"__{c}") for c in new.columns])
    own = thought.withColumn("__first", F.row_number().over(W.partitionBy("content_hash").orderBy("thought_id")) == 1)
    joined = own.join(fresh, (F.col("content_hash") == F.col("__content_hash")) & F.col("__first"), "full_outer")
    known = F.col("thought_id").isNotNull()
    given = lambda c: F.col(f"__{c}") if c in new.columns else F.lit(None)
    changed = lambda c: F.when(F.col("__content_hash").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) if c in columns and c in new.columns else F.col(c)
    return joined.select(*[F.when(known, changed(c)).otherwise(given(c)).alias(c) for c in thought.columns])


def create(
    thought: DataFrame, new: DataFrame, now: datetime, *, deduplicate: bool = False, ttl_s: int | None = None, default_ttl_s: int | None = None, on_store: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(thought with the new rows, new rows whose id is there already or repeats, which aren't stored).

    Expiry: the call's, else the row's own, else the store's default. With deduplicate a row whose content is
    known, or came before in the batch, isn't stored and confirms the record that has it once more. on_store
    enriches the rows that are stored.
    """
    hook = on_store or (lambda df: df)
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    after = lambda s: F.timestamp_add("SECOND", F.lit(s), at)
    own = F.col("expires_at") if "expires_at" in new.columns else F.lit(None).cast("timestamp_ntz")
    expires = after(ttl_s) if ttl_s is not None else F.coalesce(own, after(default_ttl_s)) if default_ttl_s is not None else own
    rows = new.withColumn("expires_at", expires).withColumn("content_hash", F.sha2("content", 256))
    rows = rows.withColumn("created_at", F.coalesce("created_at", at) if "created_at" in rows.columns else at)
    nth = F.row_number().over(W.partitionBy("thought_id").orderBy("content_hash"))
    rows = rows.withColumn("__nth", nth)
    conflict = rows.join(thought.select("thought_id"), "thought_id", "left_semi").unionByName(rows.filter("__nth > 1").join(thought.select("thought_id"), "thought_id", "left_anti")).drop("__nth")
    rows = rows.filter("__nth = 1").drop("__nth").join(thought.select("thought_id"), "thought_id", "left_anti")
    if not deduplicate:
        return thought.unionByName(hook(rows), allowMissingColumns=True), conflict
    told = get_or_create(thought, rows)
    hits = told.filter("NOT created").groupBy(F.col("thought_id").alias("__id")).agg(F.count("*").alias("__n"))
    created = rows.join(told.filter("created").select("thought_id"), "thought_id", "left_semi")
    all_ = thought.unionByName(hook(created), allowMissingColumns=True).join(hits, F.col("thought_id") == F.col("__id"), "left")
    more = (F.coalesce("confirmation_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("confirmation_count")
    return all_.select(*[more if c == "confirmation_count" else F.col(c) for c in thought.columns]), conflict


def bulk_store(thought: DataFrame, new: DataFrame, now: datetime, **how) -> DataFrame:
    """thought with all new rows, or an error and none of them: one plan, so one atomic write. One job tells conflicts."""
    out, conflict = create(thought, new, now, **how)
    n = conflict.count()
    if n:
        raise ValueError(f"{n} rows have an id that is there already")
    return out


def remembered(texts: DataFrame, text_col: str = "text", id_col: str = "thought_id", metadata_col: str | None = None) -> DataFrame:
    """Records made of bare texts: active notes of priority P3 at cycle 0, essence the first 200 characters."""
    fixed = [F.lit(v).alias(k) for k, v in DEFAULTS.items()]
    zero = [F.lit(0).cast("long").alias(c) for c in ("created_cycle", "updated_cycle", "confirmation_count", "access_count")]
    meta = F.lit("{}") if metadata_col is None else F.coalesce(metadata_col, F.lit("{}"))
    return texts.select(
        F.col(id_col).alias("thought_id"), F.col(text_col).alias("content"), F.substring(text_col, 1, 200).alias("essence"), F.sha2(text_col, 256).alias("content_hash"),
        *fixed, *zero, meta.alias("metadata_json"), F.lit(1).cast("long").alias("revision"),
    )


#: Which state may follow which.
LIFECYCLE = {"CREATED": ("ACTIVE",), "ACTIVE": ("DONE", "ARCHIVED"), "DONE": ("ARCHIVED",), "ARCHIVED": ("ACTIVE",)}
ACTION_STATES = {"PLANNED": ("EXECUTING", "BLOCKED"), "EXECUTING": ("CONFIRMED", "FAILED"), "CONFIRMED": (), "FAILED": (), "BLOCKED": ("PLANNED",)}


def may_follow(states: dict[str, tuple[str, ...]], old: Column, new: Column) -> Column:
    """Whether the new state may follow the old one; staying is no transition, and an unknown state has none."""
    out = F.lit(False)
    for state, after in states.items():
        if after:
            out |= (old == state) & new.isin(*after)
    return F.coalesce(out, F.lit(False))


def update(thought: DataFrame, changes: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with matching changes applied and their revision raised, changes whose id and revision match no row)."""
    new = changes.select("thought_id", "revision", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = thought.join(new, ["thought_id", "revision"], "left")
    out = joined.select("thought_id", *[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns], (F.col("revision") + F.coalesce("__hit", F.lit(False)).cast("long")).alias("revision"))
    return out, changes.join(thought.select("thought_id", "revision"), ["thought_id", "revision"], "left_anti")


def restore(thought: DataFrame, ids: DataFrame, cycle: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(thought with the archived ones of ids (thought_id) active again and without their stamps, ids that aren't archived or aren't there)."""
    rows = thought.join(ids.select(F.col("thought_id").alias("__id")).distinct(), F.col("thought_id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull() & may_follow({"ARCHIVED": LIFECYCLE["ARCHIVED"]}, F.col("lifecycle_status"), F.lit("ACTIVE"))
    to = {"lifecycle_status": F.lit("ACTIVE"), "archived_at_cycle": F.lit(None), "archived_at": F.lit(None), "revision": F.col("revision") + 1}
    if cycle is not None:
        to["updated_cycle"] = F.lit(cycle).cast("long")
    out = rows.select(*[F.when(hit, to[c]).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in thought.columns])
    return out, ids.join(thought.filter("lifecycle_status = 'ARCHIVED'").select("thought_id"), "thought_id", "left_anti")


def create_edges(edge: DataFrame, new: DataFrame, thought: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge with the new rows, new rows that can't be with the reason): an end that is no record, a weight outside 0..1, or
    a (from, to, type) that is there already or comes again in the batch."""
    key = ["from_thought_id", "to_thought_id", "edge_type"]
    ids = thought.select(F.col("thought_id").alias("__id")).distinct()
    ends = new.join(ids.withColumnRenamed("__id", "__a"), F.col("from_thought_id") == F.col("__a"), "left").join(ids.withColumnRenamed("__id", "__b"), F.col("to_thought_id") == F.col("__b"), "left")
    known = edge.select(*key).distinct().withColumn("__known", F.lit(True))
    nth = F.row_number().over(W.partitionBy(*key).orderBy("edge_id"))
    told = ends.join(known, key, "left").withColumn("__nth", nth)
    why = F.when(F.col("__a").isNull() | F.col("__b").isNull(), "endpoint").when(~F.coalesce(F.col("weight").between(0, 1), F.lit(True)), "weight").when(F.col("__known") | (F.col("__nth") > 1), "duplicate")
    told = told.withColumn("reason", why)
    return edge.unionByName(told.filter("reason IS NULL").select(*new.columns), allowMissingColumns=True), told.filter("reason IS NOT NULL").select(*new.columns, "reason")


def store_embeddings(embedding: DataFrame, new: DataFrame) -> DataFrame:
    """embedding with the new rows in the place of their owners' old ones. All vectors have one model and dimension, or none is stored."""
    identity = embedding.select("model_name", "dimension").unionByName(new.select("model_name", "dimension")).distinct().limit(2).collect()
    if len(identity) > 1:
        raise ValueError(f"the store holds one kind of vectors, not {sorted(map(tuple, identity))}")
    if new.filter(F.size("vector") != F.col("dimension")).limit(1).count():
        raise ValueError("a vector has another length than it says")
    return embedding.join(new.select("owner_id"), "owner_id", "left_anti").select(*embedding.columns).unionByName(new, allowMissingColumns=True)


def update_actions(action: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(action with legal changes (action_id, status, verification_status) applied, changes that aren't legal).

    A status that stays is legal where only the verification changes; a null keeps what is there.
    """
    new = changes.select("action_id", F.col("status").alias("__status"), F.col("verification_status").alias("__verification"), F.lit(True).alias("__hit"))
    joined = action.join(new, "action_id", "left")
    to = F.coalesce("__status", "status")
    legal = F.col("__hit") & ((to == F.col("status")) | may_follow(ACTION_STATES, F.col("status"), to))
    legal = F.coalesce(legal, F.lit(False))
    out = joined.select(*[F.when(legal, to).otherwise(F.col(c)).alias(c) if c == "status" else F.when(legal, F.coalesce("__verification", c)).otherwise(F.col(c)).alias(c) if c == "verification_status" else F.col(c) for c in action.columns])
    bad = changes.join(joined.filter(legal).select("action_id"), "action_id", "left_anti")
    return out, bad


def outcomes(action: DataFrame) -> DataFrame:
    """(source_thought_id, score): the mean over a record's terminal actions; null without one. A failed action is 0, a confirmed
    one 1, 0 or a half by its verification."""
    told = F.when(F.col("verification_status") == "CONFIRMED", 1.0).when(F.col("verification_status") == "FAILED", 0.0).otherwise(0.5)
    return action.groupBy("source_thought_id").agg(F.avg(F.when(F.col("status") == "FAILED", 0.0).when(F.col("status") == "CONFIRMED", told)).alias("score"))


def dangling(thought: DataFrame, edge: DataFrame, action: DataFrame, embedding: DataFrame) -> DataFrame:
    """(table, id) of edges, actions and vectors that name a record which isn't there."""
    ids = thought.select(F.col("thought_id").alias("__id"))
    out = None
    for name, df, key, ends in (("edge", edge, "edge_id", ("from_thought_id", "to_thought_id")), ("action", action, "action_id", ("source_thought_id",)), ("embedding", embedding, "embedding_id", ("owner_id",))):
        for end in ends:
            part = df.join(ids, F.col(end) == F.col("__id"), "left_anti").select(F.lit(name).alias("table"), F.col(key).alias("id"))
            out = part if out is None else out.unionByName(part)
    return out.distinct()


def invalidate(rows: DataFrame, which: Column, until: datetime) -> DataFrame:
    end = F.lit(until.isoformat(sep=" ")).cast("timestamp_ntz")
    return rows.withColumn("valid_until", F.when(which & (F.col("valid_until").isNull() | (F.col("valid_until") > end)), end).otherwise(F.col("valid_until")))


def delete(gone: DataFrame, thought: DataFrame, edge: DataFrame, embedding: DataFrame, action: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the records in gone and what hangs on them."""
    ids = gone.select(F.col("thought_id").alias("__id")).distinct()
    drop = lambda df, c: df.join(ids, F.col(c) == F.col("__id"), "left_anti")
    return {"thought": drop(thought, "thought_id"), "edge": drop(drop(edge, "from_thought_id"), "to_thought_id"), "embedding": drop(embedding, "owner_id"), "action": drop(action, "source_thought_id")}


def expire(thought: DataFrame, now: datetime, strategy: str = "archive", exclude: str | None = None) -> DataFrame:
    """(thought_id, outcome) of expired rows: kept if pinned, else archived or deleted as the strategy says."""
    if strategy not in ("archive", "delete"):
        raise ValueError("expired rows are archived or deleted")
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    gone = thought.filter((F.col("expires_at") <= at) & (F.lit(True) if exclude is None else F.col("thought_id") != exclude))
    if strategy == "archive":
        gone = gone.filter(F.col("pinned") | (F.col("lifecycle_status") != "ARCHIVED"))
    return gone.select("thought_id", F.when(F.col("pinned"), "kept").otherwise(f"{strategy}d").alias("outcome"))


def expired_counts(outcome: DataFrame) -> DataFrame:
    """One row of expire's counts: processed, kept because pinned."""
    return outcome.agg(F.count_if(F.col("outcome") != "kept").alias("processed"), F.count_if(F.col("outcome") == "kept").alias("pinned"))


def touched(thought: DataFrame, accesses: DataFrame) -> DataFrame:
    """thought with its access counts raised by the accesses (thought_id, at), a buffer of any size, and the latest instant kept."""
    seen = accesses.groupBy(F.col("thought_id").alias("__id")).agg(F.count("*").alias("__n"), F.max("at").alias("__at"))
    rows = thought.join(seen, F.col("thought_id") == F.col("__id"), "left")
    to = {"access_count": F.col("access_count") + F.coalesce("__n", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "__at")}
    return rows.select(*[to[c].alias(c) if c in to else F.col(c) for c in thought.columns])


def canonical(delta: str | None) -> str:
    """A JSON text as it enters the hash: keys sorted, one form of white space, ASCII. What is no JSON enters as it is; null is {}."""
    if delta is None:
        return "{}"
    try:
        return json.dumps(json.loads(delta), sort_keys=True)
    except ValueError:
        return delta


def entry_hash(number: int, kind: str, target: str | None, delta: str | None, parent: str | None) -> str:
    return hashlib.sha256(f"{number}|{kind}|{target or ''}|{canonical(delta)}|{parent or ''}".encode()).hexdigest()


_JOURNAL = ("sequence_number", "mutation_type", "target_id", "delta")


def append_journal(entries: DataFrame, service: str | None = None) -> DataFrame:
    """(service, sequence_number, parent_hash, entry_hash) of entries, one chain per service in the order of sequence_number.

    Each hash needs the one before, so a service's entries are folded in one task; services are dealt. A
    task sorts its entries, reads them once and holds a batch at a time. Without a service there is one chain.
    """
    own = F.lit("") if service is None else F.coalesce(F.col(service).cast("string"), F.lit(""))
    rows = entries.select(own.alias("service"), F.col("sequence_number").cast("long").alias("sequence_number"), *_JOURNAL[1:])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in batches:
            parents, hashes = [], []
            for name, number, kind, target, delta in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != at:
                    at, last = name, None
                parents.append(last)
                last = entry_hash(number, kind, target, delta, last)
                hashes.append(last)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(parents, pa.string()), pa.array(hashes, pa.string())], names=["service", "sequence_number", "parent_hash", "entry_hash"])

    dealt = rows.repartition("service") if service is not None else rows.coalesce(1)
    chain = dealt.sortWithinPartitions("service", *_JOURNAL).mapInArrow(fold, "service string, sequence_number long, parent_hash string, entry_hash string")
    return chain if service is not None else chain.drop("service")


def verify_journal(chain: DataFrame, service: str | None = None, block: int = 1 << 12) -> DataFrame:
    """(service, first_broken, entries, valid) per service: the first entry whose hash or parent doesn't fit; null if the chain holds.

    Hashes are recomputed where the entries are. Links are checked in blocks of sequence numbers, and between
    blocks by their last entries, so that no task holds a whole chain. A tail that was cut off isn't seen.
    """
    own = F.lit("") if service is None else F.coalesce(F.col(service).cast("string"), F.lit(""))
    rows = chain.select(own.alias("service"), F.col("sequence_number").cast("long").alias("sequence_number"), *_JOURNAL[1:], "parent_hash", "entry_hash")

    def rehash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, numbers, kinds, targets, deltas, parents, hashes = (c.to_pylist() for c in batch.columns)
            wrong = [entry_hash(*x) != y for x, y in zip(zip(numbers, kinds, targets, deltas, parents, strict=True), hashes, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(5), batch.column(6), pa.array(wrong, pa.bool_())], names=["service", "sequence_number", "parent_hash", "entry_hash", "wrong"])

    told = rows.mapInArrow(rehash, "service string, sequence_number long, parent_hash string, entry_hash string, wrong boolean").withColumn("block", F.floor(F.col("sequence_number") / block))
    inside = W.partitionBy("service", "block").orderBy("sequence_number")
    linked = told.withColumn("before", F.lag("entry_hash").over(inside)).withColumn("head", F.row_number().over(inside) == 1)
    ends = told.groupBy("service", "block").agg(F.max_by("entry_hash", "sequence_number").alias("last"))
    ends = ends.select("service", "block", F.lag("last").over(W.partitionBy("service").orderBy("block")).alias("last_before"))
    linked = linked.join(ends, ["service", "block"])
    previous = F.when(F.col("head"), F.col("last_before")).otherwise(F.col("before"))
    bad = F.col("wrong") | ~F.col("parent_hash").eqNullSafe(previous)
    out = linked.groupBy("service").agg(F.min(F.when(bad, F.col("sequence_number"))).alias("first_broken"), F.count("*").alias("entries"))
    out = out.withColumn("valid", F.col("first_broken").isNull())
    return out if service is not None else out.drop("service")


def read_journal(journal: DataFrame, target: str | None = None, kind: str | None = None, since: datetime | None = None, limit: int = 100) -> DataFrame:
    """The first entries in order, of a target, a kind, or since an instant."""
    for name, value in (("target_id", target), ("mutation_type", kind)):
        if value is not None:
            journal = journal.filter(F.col(name) == value)
    if since is not None:
        journal = journal.filter(F.col("created_at") >= F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz"))
    return journal.orderBy("sequence_number").limit(limit)
