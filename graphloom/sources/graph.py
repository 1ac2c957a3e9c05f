"""A memory graph made from plain tables: one template of each view, in Spark's SQL or in DuckDB's.

Ids, states, weights and bounds follow from integer arithmetic on the tables' keys, so both engines make the
same rows. Every open and closed combination of validity bounds occurs, and missing, null and malformed
metadata do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-02-15 00:00:00"
CYCLE = 100

_THOUGHT = """
SELECT concat('d', lpad(cast(doc_id AS {S}), 9, '0')) AS thought_id,
  CASE WHEN doc_id % 11 = 0 THEN 'REFLECTION' WHEN doc_id % 5 = 1 THEN 'TASK' WHEN doc_id % 5 = 2 THEN 'BELIEF' WHEN doc_id % 5 = 3 THEN 'NOTE' ELSE 'OBSERVATION' END AS thought_type,
  substr(text, 1, 200) AS essence, text AS content, sha2_256(text) AS content_hash,
  concat('P', cast(1 + doc_id % 4 AS {S})) AS priority,
  CASE WHEN doc_id % 13 = 0 THEN 'CREATED' WHEN doc_id % 13 = 1 THEN 'DONE' WHEN doc_id % 13 = 2 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS lifecycle_status,
  doc_id % 50 AS created_cycle, doc_id % 50 + doc_id % 37 AS updated_cycle, source,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE cast(doc_id % 101 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN doc_id % 11 = 0 THEN 'DREAMING' WHEN doc_id % 3 = 0 THEN 'SEEDED_LLM' ELSE 'EXPERIENCE' END AS source_type,
  doc_id % 7 AS confirmation_count, CASE WHEN doc_id % 9 = 0 THEN 'private' WHEN doc_id % 9 = 1 THEN 'shared' ELSE 'public' END AS visibility,
  doc_id % 12 AS access_count, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE {T} '2024-01-01 00:00:00' + (doc_id % 40) * INTERVAL '1' DAY END AS last_accessed_at,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {T} '2024-01-01 00:00:00' + (doc_id % 30) * INTERVAL '1' DAY END AS created_at,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE {T} '2024-01-01 00:00:00' + (doc_id % 30 + doc_id % 20) * INTERVAL '1' DAY END AS updated_at,
  CASE WHEN doc_id % 8 = 0 THEN {T} '2024-02-01 00:00:00' + (doc_id % 30) * INTERVAL '1' DAY END AS expires_at,
  CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '{{broken' WHEN 2 THEN concat('{{"lang":null,"source":"', source, '"}}')
    ELSE concat('{{"lang":"', lang, '","rank":', cast(doc_id % 5 AS {S}), ',"flag":', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"owner":"u', cast(doc_id % 6 AS {S}), '","nested":{{"k":"', cast(doc_id % 3 AS {S}), '"}}',
      CASE doc_id % 5 WHEN 0 THEN ',"perspective":"percept"' WHEN 1 THEN ',"perspective":"utterance"' WHEN 2 THEN ',"perspective":"thought"' ELSE '' END,
      CASE doc_id % 8 WHEN 0 THEN ',"source":{{"is_self":true,"confidence":"high"}}' WHEN 1 THEN ',"source":{{"is_self":false,"confidence":"medium"}}' WHEN 2 THEN ',"source":{{"is_self":"false","confidence":"sure"}}' WHEN 3 THEN concat(',"source":"', source, '"') WHEN 4 THEN ',"source":{{"confidence":"low"}}' WHEN 5 THEN ',"source":{{"is_self":false,"confidence":"high"}}' ELSE '' END,
      CASE doc_id % 9 WHEN 0 THEN ',"content_type":"code"' WHEN 1 THEN ',"content_type":"natural_language"' ELSE '' END, '}}') END AS metadata_json,
  CASE WHEN doc_id % 4 IN (0, 1) THEN NULL ELSE {T} '2024-01-01 00:00:00' + (doc_id % 60) * INTERVAL '1' DAY END AS valid_from,
  CASE WHEN doc_id % 4 IN (0, 2) THEN NULL ELSE {T} '2024-01-01 00:00:00' + (doc_id % 60 + doc_id % 25) * INTERVAL '1' DAY END AS valid_until,
  CASE WHEN doc_id % 10 = 0 THEN NULL ELSE concat('{{"run":{{"id":"r', cast(doc_id % 4 AS {S}), '"}}}}') END AS provenance,
  doc_id % 23 = 0 AS pinned,
  CASE WHEN doc_id % 13 = 2 AND doc_id % 2 = 0 THEN doc_id % 95 END AS archived_at_cycle,
  CASE WHEN doc_id % 13 = 2 AND doc_id % 2 = 0 THEN {T} '2023-12-01 00:00:00' + (doc_id % 90) * INTERVAL '1' DAY END AS archived_at,
  CASE WHEN doc_id % 3 = 0 THEN cast(doc_id % 11 AS DOUBLE) / 10 END AS action_outcome_score, cast(1 AS BIGINT) AS revision
FROM documents
"""

_EDGE = """
SELECT concat('e', lpad(cast(e AS {S}), 10, '0')) AS edge_id, concat('d', lpad(cast(a AS {S}), 9, '0')) AS from_thought_id, concat('d', lpad(cast(b AS {S}), 9, '0')) AS to_thought_id,
  edge_type, cast((a * 31 + b * 17) % 100 AS DOUBLE) / 100 AS weight, (a + b) % 60 AS created_cycle, CASE WHEN edge_type = 'CONSOLIDATED_FROM' THEN 'DREAMING' ELSE 'EXPERIENCE' END AS source,
  cast(1 AS DOUBLE) AS decay_multiplier,
  CASE WHEN e % 4 IN (0, 1) THEN NULL ELSE {T} '2024-01-01 00:00:00' + (e % 60) * INTERVAL '1' DAY END AS valid_from,
  CASE WHEN e % 4 IN (0, 2) THEN NULL ELSE {T} '2024-01-01 00:00:00' + (e % 60 + e % 25) * INTERVAL '1' DAY END AS valid_until
FROM (
  SELECT doc_id * 8 AS e, doc_id AS a, (doc_id * 7 + 3) % n AS b, 'ASSOCIATED' AS edge_type FROM documents CROSS JOIN (SELECT count(*) AS n FROM documents) x
  UNION ALL SELECT doc_id * 8 + 1, doc_id, (doc_id * 5 + 11) % n, 'DEPENDS_ON' FROM documents CROSS JOIN (SELECT count(*) AS n FROM documents) y WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id * 8 + 2 + k, doc_id, (doc_id * 3 + 13 * k + 1) % n, 'CONSOLIDATED_FROM' FROM documents CROSS JOIN (SELECT count(*) AS n FROM documents) z CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) w WHERE doc_id % 11 = 0
) t WHERE a != b
"""

_EMBEDDING = """
SELECT concat('v', lpad(cast(vec_id AS {S}), 9, '0')) AS embedding_id, 'thought' AS owner_type, concat('d', lpad(cast(vec_id AS {S}), 9, '0')) AS owner_id, 'plain-64' AS model_name, {LEN}(embedding) AS dimension, embedding AS vector FROM embeddings
"""

_ACTION = """
SELECT concat('a', lpad(cast(event_id AS {S}), 9, '0')) AS action_id, concat('d', lpad(cast(user_id * 7 % n AS {S}), 9, '0')) AS source_thought_id,
  CASE event_id % 4 WHEN 0 THEN 'CLI_OUTPUT' WHEN 1 THEN 'TOOL_CALL' WHEN 2 THEN 'MESSAGE' ELSE 'STATE_UPDATE' END AS action_type, event_type AS intent,
  CASE event_id % 5 WHEN 0 THEN 'PLANNED' WHEN 1 THEN 'EXECUTING' WHEN 2 THEN 'CONFIRMED' WHEN 3 THEN 'FAILED' ELSE 'CONFIRMED' END AS status,
  CASE event_id % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'FAILED' ELSE 'PENDING' END AS verification_status, ts AS created_at
FROM events CROSS JOIN (SELECT count(*) AS n FROM documents) x
"""

_JOURNAL = """
SELECT concat('s', cast(user_id % 16 AS {S})) AS service, cast(row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS BIGINT) AS sequence_number, upper(event_type) AS mutation_type,
  CASE WHEN event_id % 7 > 0 THEN concat('d', cast(user_id AS {S})) END AS target_id, props AS delta, ts AS created_at FROM events
"""

VIEWS = {"thought": _THOUGHT, "edge": _EDGE, "embedding": _EMBEDDING, "action": _ACTION, "journal_input": _JOURNAL}


def spark_sql(view: str) -> str:
    return VIEWS[view].format(S="STRING", T="TIMESTAMP_NTZ", LEN="size").replace("sha2_256(text)", "sha2(text, 256)")


def duck_sql(view: str) -> str:
    return VIEWS[view].format(S="VARCHAR", T="TIMESTAMP", LEN="len").replace("sha2_256(text)", "sha256(text)")


def with_views(sql: str, *views: str) -> str:
    """DuckDB SQL that sees the named views; sql is a query, or starts with a comma and further views."""
    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({duck_sql(v)})" for v in views) + " " + sql


class Graph:
    """The views of one folder of tables, each a lazy plan: scans prune columns and push filters."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        need = {"thought": ("documents",), "edge": ("documents",), "embedding": ("embeddings",), "action": ("events", "documents"), "journal_input": ("events",)}[name]
        sql, tag = spark_sql(name), uuid.uuid4().hex[:8]
        for t in need:
            self.base(t).createOrReplaceTempView(f"{t}_{tag}")
            sql = sql.replace(f"FROM {t}", f"FROM {t}_{tag}")
        out = self.spark.sql(sql)
        for t in need:
            self.spark.catalog.dropTempView(f"{t}_{tag}")
        return out

    @property
    def thought(self) -> DataFrame:
        return self.view("thought")

    @property
    def edge(self) -> DataFrame:
        return self.view("edge")

    @property
    def embedding(self) -> DataFrame:
        return self.view("embedding")

    @property
    def action(self) -> DataFrame:
        return self.view("action")

    @property
    def journal_input(self) -> DataFrame:
        return self.view("journal_input")
