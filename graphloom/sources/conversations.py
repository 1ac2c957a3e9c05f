"""Conversations as records: nested question files, and tables of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TURN = "struct<role:string,content:string>"
SCHEMA = f"question_id string, question_type string, question string, answer string, question_date string, haystack_sessions array<struct<session_id:string,turns:array<{_TURN}>>>, answer_session_ids array<string>"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """One row per question of JSON files, each an array of questions with their sessions of turns; files are read whole."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def turns(question: DataFrame) -> DataFrame:
    """(question_id, session_id, session, turn, role, content, has_answer) of every turn, places from 0."""
    session = question.select("question_id", "answer_session_ids", F.posexplode("haystack_sessions").alias("session", "s"))
    told = session.select("question_id", "session", F.col("s")["session_id"].alias("session_id"), F.coalesce(F.array_contains("answer_session_ids", F.col("s")["session_id"]), F.lit(False)).alias("has_answer"), F.posexplode(F.col("s")["turns"]).alias("turn", "t"))
    return told.select("question_id", "session_id", "session", "turn", F.col("t")["role"].alias("role"), F.col("t")["content"].alias("content"), "has_answer")


def metadata(kind: str, *, is_self: bool = False, source_id: str | None = None, label: str | None = None, confidence: str = "high", lang: str = "en") -> Column:
    """A record's metadata as JSON: a percept from outside, or the agent's own utterance or thought."""
    if kind not in ("percept", "utterance", "thought") or confidence not in ("high", "medium", "low"):
        raise ValueError("a percept, utterance or thought, of high, medium or low confidence")
    if kind != "percept":
        is_self, source_id, label, confidence = True, None, None, "high"
    source = F.struct(F.lit(is_self).alias("is_self"), F.lit(confidence).alias("confidence"), F.lit(source_id).alias("id"), F.lit(label).alias("label"))
    return F.to_json(F.struct(F.lit(kind).alias("perspective"), source.alias("source"), F.lit(lang).alias("lang"), F.lit("natural_language").alias("content_type")))


def substring_hit(answer: Column, content: Column) -> Column:
    """Whether content holds the answer, in any case; an empty answer is never held."""
    return F.coalesce((F.length(answer) > 0) & F.contains(F.lower(content), F.lower(answer)), F.lit(False))


def mean_scores(scores: DataFrame) -> DataFrame:
    """(question_type, questions, mean) per type, and over all where the type is null, from (question_type, score)."""
    return scores.rollup("question_type").agg(F.count("*").alias("questions"), F.avg("score").alias("mean"))
