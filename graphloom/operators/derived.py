"""Derived records: a producer makes up to a bound of new records from each, whose ids follow from their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST = 32


def derive(
    source: DataFrame, produce: Column, thought: DataFrame, edge: DataFrame, *, cycle: int = 0, most: int = MOST, on_error: str = "raise", enabled: bool = True, attach: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new records, new DERIVED_FROM edges, (thought_id, created, reused, skipped) per source).

    produce gives an array of texts for each row of source, as a Column, a Python function behind a
    pandas_udf, or a split. A child's id follows from its content, so that running again makes nothing new,
    and equal children of several sources are one record with an edge to each. A source that was derived
    itself has no children. A source with over `most` children is an error, or skipped whole with
    on_error="log". Null children are left out.
    """
    if on_error not in ("raise", "log"):
        raise ValueError("an error is raised or logged")
    if not enabled:
        source = source.limit(0)
    made = edge.filter("edge_type = 'DERIVED_FROM'").select(F.col("from_thought_id").alias("thought_id")).distinct()
    rows = source.join(made, "thought_id", "left_anti").withColumn("__children", F.filter(F.coalesce(produce, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    over = F.size("__children") > most
    if on_error == "raise" and rows.filter(over).limit(1).count():
        raise ValueError(f"a record has over {most} derived ones")
    child = rows.filter(~over).select(F.col("thought_id").alias("source_id"), F.posexplode("__children").alias("segment_index", "content"))
    child = child.withColumn("thought_id", F.concat(F.lit("c"), F.substring(F.sha2("content", 256), 1, 32)))
    known = thought.select("thought_id", F.lit(True).alias("__known"))
    told = child.join(known, "thought_id", "left").withColumn("__nth", F.row_number().over(W.partitionBy("thought_id").orderBy("source_id", "segment_index")))
    fresh = F.col("__known").isNull() & (F.col("__nth") == 1)
    new = told.filter(fresh).select(
        "thought_id", F.lit("OBSERVATION").alias("thought_type"), "content", F.substring("content", 1, 200).alias("essence"), F.sha2("content", 256).alias("content_hash"), F.lit("P3").alias("priority"),
        F.lit("ACTIVE").alias("lifecycle_status"), F.lit(cycle).cast("long").alias("created_cycle"), F.lit(cycle).cast("long").alias("updated_cycle"), F.concat(F.lit("derived:"), "source_id").alias("source"),
    )
    links = told.select(F.col("thought_id").alias("from_thought_id"), F.col("source_id").alias("to_thought_id")).distinct().filter(F.lit(attach))
    there = edge.filter("edge_type = 'DERIVED_FROM'").select("from_thought_id", "to_thought_id")
    links = links.join(there, ["from_thought_id", "to_thought_id"], "left_anti").select(
        F.concat("from_thought_id", F.lit(">"), "to_thought_id").alias("edge_id"), "from_thought_id", "to_thought_id", F.lit("DERIVED_FROM").alias("edge_type"), F.lit(1.0).alias("weight"),
        F.lit(cycle).cast("long").alias("created_cycle"), F.lit("EXPERIENCE").alias("source"),
    )
    count = told.groupBy(F.col("source_id").alias("thought_id")).agg(F.count_if(fresh).alias("created"), F.count_if(~fresh).alias("reused"))
    skipped = rows.select("thought_id", F.when(over, F.size("__children")).otherwise(0).cast("long").alias("skipped"))
    tally = skipped.join(count, "thought_id", "left").select("thought_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("created", "reused")], "skipped")
    return new, links, tally
