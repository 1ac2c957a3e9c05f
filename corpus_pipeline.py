"""A training corpus from documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import drop_written, fresh_path, written
from graphloom.llm.exact_dedup import drop_copies
from graphloom.llm.mixing import repeat_documents
from graphloom.llm.packing import digest, pack_documents
from graphloom.llm.quality_rules import keep_good
from graphloom.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; null and empty texts have too few words. No row is compared with another."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays; null counts as empty. Rows are told apart by number, so null and repeated ids are judged like others."""
    return drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one document stays, the smallest id; a null id comes last, and equal ids by place."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. A null source is one of its own; documents without a word go."""
    return repeat_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null or empty text is its end id alone. An empty table is an empty result, here and in the stages before."""
    return digest(pack_documents(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SimHash, subset sums and the tokenizer are beyond SQL; tests hold run() to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and its input's, go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = written()
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_written(begin, path)
        docs = spark.read.parquet(path)
    return docs
