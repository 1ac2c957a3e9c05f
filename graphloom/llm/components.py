"""Connected components of a large edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, latest, materialize, written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b): long ids, any order, repeats and loops allowed. Returns (node, root), root the smallest id reachable.

    Every step (Kiveris et al., "Connected Components in MapReduce and Beyond") replaces edges and never
    adds any, so work stays in proportion to the edges; a few steps do, as their number grows with the
    logarithm of the longest path. The ids' minima are written before they are joined, so that both sides
    of the join are shuffled anew and a hub's rows can be split. A step's tables go once the next are written.
    """
    begin = written()
    cur = materialize(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    state = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = materialize(
            cur.select(F.col("v").alias("u"), F.col("u").alias("v"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct(),
            name,
        )
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        cur = materialize(small.filter("u != v").distinct(), name)
        drop_written(begin, latest())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
