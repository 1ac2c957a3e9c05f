"""Access counts, sessions and the journal as streams, and when a cycle's work is due."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files under path."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def access_counts(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Accesses per record and window; state older than the watermark is dropped."""
    at = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", window), "user_id").agg(F.count("*").alias("accesses"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    at = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("events"))


def journal(spark: SparkSession, path: str, schema) -> DataFrame:
    """The entries that are appended under path, as they come; their order is that of sequence_number, not of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def due(cycle: int, every: int) -> bool:
    """Whether a cycle is one in which batch work runs: each `every`-th but the first."""
    if every < 1:
        raise ValueError("work is due every cycle or less often")
    return cycle > 0 and cycle % every == 0


class HighWater:
    """A cycle provider that follows the store: the highest cycle of its records and edges, and never goes back."""

    def __init__(self, thought: DataFrame, edge: DataFrame) -> None:
        self.thought, self.edge, self.last = thought, edge, 0

    def __call__(self) -> int:
        found = self.thought.agg(F.max("updated_cycle").alias("c")).unionByName(self.edge.agg(F.max("created_cycle").alias("c"))).agg(F.max("c")).first()[0]
        self.last = max(self.last, found or 0)
        return self.last
