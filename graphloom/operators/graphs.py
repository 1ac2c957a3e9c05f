"""Iterative graph algorithms on DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that spark.checkpoint.dir names; our own where it is unset, as in tests."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-"))
    return df.checkpoint()


def components(pairs: DataFrame) -> DataFrame:
    """(thought_id, cluster_id) of every id in pairs (a, b); a cluster has its smallest id.

    Labels spread along the edges and then jump to their label's label, so rounds grow with the logarithm
    of the longest path.
    """
    edges = _checkpointed(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = edges.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct()
    while True:
        near = edges.join(label.select(F.col("id").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        spread = label.join(near, "id").select("id", F.least("label", "other").alias("new"), F.col("label").alias("old"))
        jump = spread.select(F.col("id").alias("new"), F.col("new").alias("far"))
        moved = _checkpointed(spread.join(jump, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("label"), "old"))
        changed = moved.filter("label != old").limit(1).count()
        label = moved.select("id", "label")
        if not changed:
            return label.select(F.col("id").alias("thought_id"), F.col("label").alias("cluster_id"))


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(thought_id, cluster_id): labels that spread over undirected edges (a, b), all records at once.

    In a round each record takes the label that most of its neighbours have, the smallest of several. Records
    of one half, by a hash of the id and the round, wait, so that two neighbours don't swap labels for ever.
    It ends when no record would change, or after `rounds`. A record's own edges are counted in one task after
    partial sums per label.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = _checkpointed(both)
    label = both.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct()
    for k in range(rounds):
        votes = both.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.min_by("label", F.struct((-F.col("n")).alias("less"), "label")).alias("new")).select(F.col("a").alias("id"), "new")
        turn = F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) == 0
        moved = _checkpointed(label.join(best, "id").select("id", F.when(turn, F.col("new")).otherwise(F.col("label")).alias("label"), (F.col("new") != F.col("label")).alias("open")))
        label = moved.select("id", "label")
        if not moved.filter("open").limit(1).count():
            break
    return label.select(F.col("id").alias("thought_id"), F.col("label").alias("cluster_id"))
