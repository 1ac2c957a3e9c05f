"""The reference queries: each a Spark plan over the graph's views, most with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.embedding import bag_of_words
from .functions.metadata import matches, visible
from .functions.scoring import cosine, cycle_recency, instant_recency, priority_boost, signals
from .functions.segments import segments
from .functions.temporal import live, valid_at
from .functions.text import ACCENTED, PLAIN, ROLE_MARKERS, STARTERS, STOP_WORDS, char_windows, entities, paragraphs, tokens, truncated, word_windows
from .operators import consolidation as C
from .operators import derived as D
from .operators import hygiene as H
from .operators import reads as L
from .operators import retrieval as R
from .operators import store as S
from .plans.mql import Engine
from .sources import conversations, snapshot
from .sources.graph import CYCLE, NOW, Graph, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_NOW = datetime.fromisoformat(NOW)
#: The vector and the words of the sample searches.
_OWNER, _TERMS = "d000000007", ("apache", "license", "thand", "rely")
_LIVE = "(expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-15 00:00:00') AND (thought_type != 'REFLECTION' OR lifecycle_status = 'ACTIVE') AND lifecycle_status != 'ARCHIVED'"


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Callable[[Graph], DataFrame]], Callable[[Graph], DataFrame]]:
    def add(fn: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Graph(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql, *views) if views else sql
        return fn

    return add


def engine(g: Graph) -> Engine:
    def p1(e: Engine, args: tuple[str, ...]) -> DataFrame:
        return e.tables("thought").filter("priority = 'P1'").groupBy("thought_type").agg(F.count("*").alias("n"))

    return Engine(g.spark, g.view, _NOW, {"URGENT": p1})


def mql(name: str, text: str, sql: str, view: str, *columns: str, params: list | None = None) -> None:
    @query(name, sql, view)
    def _(g: Graph) -> DataFrame:
        out = engine(g).run(text, params)
        return out.select(*columns) if columns else out


_T = ("thought_id", "priority", "lifecycle_status", "created_cycle", "confidence")
_TC = ", ".join(_T)
mql("b1_find_default_limit", "FIND thoughts ORDER BY thought_id", f"SELECT {_TC} FROM thought ORDER BY thought_id LIMIT 100", "thought", *_T)
mql("b1_find_order_limit_offset", "FIND thoughts WHERE priority = 'P2' ORDER BY created_cycle DESC, thought_id ASC LIMIT 25 OFFSET 10", f"SELECT {_TC} FROM thought WHERE priority = 'P2' ORDER BY created_cycle DESC, thought_id LIMIT 25 OFFSET 10", "thought", *_T)
mql("b2_count_where", "COUNT thoughts WHERE confidence >= 0.5 AND thought_type = 'BELIEF'", 'SELECT count(*) AS "count" FROM thought WHERE confidence >= 0.5 AND thought_type = \'BELIEF\'', "thought")
mql("b3_select_params", "SELECT thought_type, count(*) AS n, round(avg(confidence), 6) AS mean FROM thought WHERE created_cycle > ? GROUP BY thought_type", "SELECT thought_type, count(*) AS n, round(avg(confidence), 6) AS mean FROM thought WHERE created_cycle > 20 GROUP BY thought_type", "thought", params=[20])
mql("b5_not_equal_null", "COUNT thoughts WHERE confidence != 0.5", 'SELECT count(*) AS "count" FROM thought WHERE confidence != 0.5', "thought")
mql("b5_text_in_number", "COUNT thoughts WHERE created_cycle = 'abc'", 'SELECT cast(0 AS BIGINT) AS "count"', "thought")
mql("b6_in", "FIND edges WHERE edge_type IN ('DEPENDS_ON', 'CONSOLIDATED_FROM') AND weight > 0.6 ORDER BY edge_id LIMIT 200", "SELECT edge_id, edge_type, weight FROM edge WHERE edge_type IN ('DEPENDS_ON', 'CONSOLIDATED_FROM') AND weight > 0.6 ORDER BY edge_id LIMIT 200", "edge", "edge_id", "edge_type", "weight")
mql("b7_or_and_precedence", "COUNT thoughts WHERE priority = 'P1' OR priority = 'P2' AND (lifecycle_status = 'DONE' OR confirmation_count >= 5)", 'SELECT count(*) AS "count" FROM thought WHERE priority = \'P1\' OR priority = \'P2\' AND (lifecycle_status = \'DONE\' OR confirmation_count >= 5)', "thought")
mql("b8_quoted_literal", "COUNT thoughts WHERE source = 'it''s AND so'", 'SELECT count(*) AS "count" FROM thought WHERE source = \'it\'\'s AND so\'', "thought")
mql("b12_valid_at_thought", "FIND thoughts WHERE valid_at '2024-02-01T00:00:00+00:00' ORDER BY thought_id LIMIT 500", f"SELECT {_TC} FROM thought WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-02-01 00:00:00') AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-02-01 00:00:00') ORDER BY thought_id LIMIT 500", "thought", *_T)
mql("b12_valid_at_edge", "COUNT edges WHERE valid_at 2024-02-01T00:00:00", "SELECT count(*) AS \"count\" FROM edge WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-02-01 00:00:00') AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-02-01 00:00:00')", "edge")
mql("b12_valid_now", "COUNT thoughts WHERE valid_now", f"SELECT count(*) AS \"count\" FROM thought WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{NOW}') AND (valid_until IS NULL OR valid_until > TIMESTAMP '{NOW}')", "thought")
mql("b13_valid_within", "COUNT thoughts WHERE valid_within '2024-01-10' '2024-01-20'", "SELECT count(*) AS \"count\" FROM thought WHERE (valid_from IS NULL OR valid_from < TIMESTAMP '2024-01-20 00:00:00') AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-10 00:00:00')", "thought")
mql("b14_valid_between", "COUNT thoughts WHERE valid_between '2024-01-05' '2024-02-20'", "SELECT count(*) AS \"count\" FROM thought WHERE valid_from >= TIMESTAMP '2024-01-05 00:00:00' AND valid_until <= TIMESTAMP '2024-02-20 00:00:00'", "thought")
mql("j1_custom_verb", "URGENT now", "SELECT thought_type, count(*) AS n FROM thought WHERE priority = 'P1' GROUP BY thought_type", "thought")


@query("b4_explain", """SELECT 'FIND' AS command, 'SELECT * FROM thought WHERE ((valid_from IS NULL OR valid_from <= ?) AND (valid_until IS NULL OR valid_until > ?)) AND priority = ? AND created_cycle IN (?, ?) ORDER BY confidence DESC LIMIT 5 OFFSET 2' AS sql,
  '["2024-02-15T00:00:00+00:00", "2024-02-15T00:00:00+00:00", "P1", 3, 4]' AS params""")
def _(g: Graph) -> DataFrame:
    return engine(g).run("EXPLAIN FIND thoughts WHERE valid_now AND priority = 'P1' AND created_cycle IN (3, 4) ORDER BY confidence DESC LIMIT 5 OFFSET 2")


_JSON = "CASE WHEN json_valid(metadata_json) THEN metadata_json END"
_META = "metadata_json"


def _meta(name: str, column, sql: str) -> None:
    @query(name, f"SELECT thought_id FROM (SELECT thought_id, {_JSON} AS j FROM thought) t WHERE j IS NOT NULL AND {sql}", "thought")
    def _(g: Graph) -> DataFrame:
        return g.thought.filter(column()).select("thought_id")


_meta("b17_meta_eq", lambda: matches(_META, [("$.lang", "en")]), "json_extract_string(j, '$.lang') = 'en'")
_meta("b17_meta_in", lambda: matches(_META, [("$.lang", ("de", "fr")), ("$.rank", 2)]), "json_extract_string(j, '$.lang') IN ('de', 'fr') AND try_cast(json_extract_string(j, '$.rank') AS DOUBLE) = 2")
_meta("b17_meta_nested", lambda: matches(_META, [("$.nested.k", "1")]), "json_extract_string(j, '$.nested.k') = '1'")
_meta("b18_eq_null", lambda: matches(_META, [("$.lang", None)]), "json_extract_string(j, '$.lang') IS NULL")
_meta("b18_empty_in", lambda: matches(_META, [("$.lang", ())]), "false")
_meta("b19_bool_alias", lambda: matches(_META, [("$.flag", 1)]), "json_extract_string(j, '$.flag') = 'true'")
_meta("b20_visibility_or_owner", lambda: matches(_META, [], visible(_META, "$.lang", ("es",), "$.owner", "u3")), "(json_extract_string(j, '$.lang') = 'es' OR json_extract_string(j, '$.owner') = 'u3')")
_meta("b21_malformed_guard", lambda: matches(_META, []), "true")


@query("b22_provenance", "SELECT thought_id FROM thought WHERE json_extract_string(provenance, '$.run.id') = 'r2'", "thought")
def _(g: Graph) -> DataFrame:
    return g.thought.filter(matches(F.col("provenance"), [("$.run.id", "r2")])).select("thought_id")


@query("b23_live_rows", f"SELECT thought_id FROM thought WHERE {_LIVE}", "thought")
def _(g: Graph) -> DataFrame:
    return g.thought.filter(live(_NOW)).select("thought_id")


_CONF = "CASE json_extract_string(j, '$.source.confidence') WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


def _may(name: str, sql: str, **how) -> None:
    """Records without metadata may take part; else perspective, is_self (a boolean only), confidence and content type decide."""
    @query(name, f"SELECT thought_id FROM (SELECT thought_id, {_JSON} AS j FROM thought) t WHERE j IS NULL OR (coalesce(json_extract_string(j, '$.content_type'), '') != 'code' AND {sql})", "thought")
    def _(g: Graph) -> DataFrame:
        return g.thought.filter(C.eligible(**how)).select("thought_id")


_may("b24_eligibility", "true")
_may("b24_external_only", "coalesce(CAST(json_extract(j, '$.source.is_self') AS VARCHAR), '') != 'true'", self_mode="external_only")
_may("b24_self_only", "coalesce(CAST(json_extract(j, '$.source.is_self') AS VARCHAR), '') != 'false'", self_mode="self_only")
_may("b24_perspective_confidence", f"coalesce(json_extract_string(j, '$.perspective'), 'percept') IN ('percept', 'utterance') AND {_CONF} >= 1", perspectives=("percept", "utterance"), min_confidence="medium")
_may("b24_content_types", "coalesce(json_extract_string(j, '$.content_type'), 'natural_language') = 'natural_language'", types=("natural_language",))


@query("c1_embedding_owner", f"SELECT embedding_id, thought_id FROM embedding JOIN thought ON owner_id = thought_id WHERE {_LIVE}", "thought", "embedding")
def _(g: Graph) -> DataFrame:
    return g.embedding.join(g.thought.filter(live(_NOW)), F.col("owner_id") == F.col("thought_id")).select("embedding_id", "thought_id")


@query("c2_unindexed_anti", "SELECT thought_id FROM thought WHERE thought_id NOT IN (SELECT owner_id FROM embedding)", "thought", "embedding")
def _(g: Graph) -> DataFrame:
    return g.thought.join(g.embedding, F.col("owner_id") == F.col("thought_id"), "left_anti").select("thought_id")


@query("c5_sources_of_reflection", "SELECT e.from_thought_id, e.to_thought_id, t.lifecycle_status FROM edge e JOIN thought t ON t.thought_id = e.to_thought_id WHERE e.edge_type = 'CONSOLIDATED_FROM'", "thought", "edge")
def _(g: Graph) -> DataFrame:
    return g.edge.filter("edge_type = 'CONSOLIDATED_FROM'").join(g.thought.select(F.col("thought_id").alias("to_thought_id"), "lifecycle_status"), "to_thought_id").select("from_thought_id", "to_thought_id", "lifecycle_status")


@query("c6_orphans", """, s AS (SELECT e.from_thought_id AS thought_id, bool_or(t.lifecycle_status = 'ACTIVE') AS alive FROM edge e JOIN thought t ON t.thought_id = e.to_thought_id WHERE e.edge_type = 'CONSOLIDATED_FROM' GROUP BY 1)
SELECT thought_id FROM thought LEFT JOIN s USING (thought_id) WHERE thought_type = 'REFLECTION' AND lifecycle_status = 'ACTIVE' AND (alive = false OR (alive IS NULL AND source_type = 'DREAMING'))""", "thought", "edge")
def _(g: Graph) -> DataFrame:
    return C.orphans(g.thought, g.edge)


_PAIRS = ", p AS (SELECT x.owner_id AS a, y.owner_id AS b, list_cosine_similarity(x.vector::DOUBLE[], y.vector::DOUBLE[]) AS sim FROM embedding x JOIN embedding y ON x.owner_id < y.owner_id WHERE list_cosine_similarity(x.vector::DOUBLE[], y.vector::DOUBLE[]) >= 0.35)"


def _pairs(g: Graph) -> DataFrame:
    return C.similar_pairs(g.embedding, 0.35)


@query("c7_similar_pairs", _PAIRS + " SELECT a, b, round(sim, 6) AS sim FROM p", "embedding")
def _(g: Graph) -> DataFrame:
    return _pairs(g).withColumn("sim", F.round("sim", 6))


@query("c8_new_neighbours", _PAIRS + """, u AS (SELECT a, b, sim FROM p UNION ALL SELECT b, a, sim FROM p), k AS (SELECT from_thought_id AS a, to_thought_id AS b FROM edge UNION SELECT to_thought_id, from_thought_id FROM edge),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM u WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = u.a AND k.b = u.b))
SELECT a AS from_thought_id, b AS to_thought_id, round(least(1.0, sim * 0.5), 6) AS weight FROM r WHERE rank <= 2""", "embedding", "edge")
def _(g: Graph) -> DataFrame:
    return C.new_neighbours(_pairs(g), g.edge, 2).withColumn("weight", F.round("weight", 6))


@query("c3_orphan_vectors", "SELECT embedding_id FROM embedding WHERE owner_id NOT IN (SELECT thought_id FROM thought)", "thought", "embedding")
def _(g: Graph) -> DataFrame:
    return g.embedding.join(g.thought, F.col("owner_id") == F.col("thought_id"), "left_anti").select("embedding_id")


@query("c12_dangling", """, a AS (SELECT thought_id FROM thought WHERE lifecycle_status = 'ACTIVE')
SELECT 'action' AS "table", action_id AS id FROM action WHERE source_thought_id NOT IN (FROM a) UNION ALL SELECT 'edge', edge_id FROM edge WHERE from_thought_id NOT IN (FROM a) OR to_thought_id NOT IN (FROM a)
UNION ALL SELECT 'embedding', embedding_id FROM embedding WHERE owner_id NOT IN (FROM a)""", "thought", "edge", "action", "embedding")
def _(g: Graph) -> DataFrame:
    return S.dangling(g.thought.filter("lifecycle_status = 'ACTIVE'"), g.edge, g.action, g.embedding)


@query("d2_counts", "SELECT 'thought' AS kind, thought_type AS type, lifecycle_status AS status, count(*) AS n FROM thought GROUP BY ROLLUP (thought_type, lifecycle_status) UNION ALL SELECT 'edge', edge_type, NULL, count(*) FROM edge GROUP BY ROLLUP (edge_type)", "thought", "edge")
def _(g: Graph) -> DataFrame:
    return L.counts(g.thought, g.edge)


@query("d3_latency_percentiles", "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 1000)")
def _(g: Graph) -> DataFrame:
    told = L.latency(g.base("events"), "value", "event_id")
    return told.select(*[F.round(c, 6).alias(c) for c in told.columns])


@query("d4_max_cycle", "SELECT coalesce(max(c), 0) AS max_cycle FROM (SELECT max(updated_cycle) AS c FROM thought UNION ALL SELECT max(created_cycle) FROM edge)", "thought", "edge")
def _(g: Graph) -> DataFrame:
    return L.max_cycle(g.thought, g.edge)


@query("d5_action_outcome", "SELECT source_thought_id, round(avg(CASE WHEN status = 'FAILED' THEN 0.0 WHEN status = 'CONFIRMED' THEN CASE verification_status WHEN 'CONFIRMED' THEN 1.0 WHEN 'FAILED' THEN 0.0 ELSE 0.5 END END), 6) AS score FROM action GROUP BY 1", "action")
def _(g: Graph) -> DataFrame:
    return S.outcomes(g.action).withColumn("score", F.round("score", 6))


_CLUSTERS = _PAIRS + """, n AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT a AS thought_id, a AS other FROM n UNION SELECT r.thought_id, n.b FROM reach r JOIN n ON n.a = r.other),
c AS (SELECT thought_id, min(other) AS cluster_id FROM reach GROUP BY 1), m AS (SELECT thought_id, cluster_id FROM c WHERE cluster_id IN (SELECT cluster_id FROM c GROUP BY 1 HAVING count(*) BETWEEN 3 AND 200))"""


def _members(g: Graph) -> DataFrame:
    return C.clusters(_pairs(g))


@query("m9_components", _CLUSTERS + " SELECT thought_id, cluster_id FROM m", "embedding")
def _(g: Graph) -> DataFrame:
    return _members(g)


@query("d8_centroid", _CLUSTERS + """, v AS (SELECT cluster_id, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM m JOIN embedding ON owner_id = thought_id), a AS (SELECT cluster_id, pos, avg(x::DOUBLE) AS value FROM v GROUP BY 1, 2)
SELECT cluster_id, pos::INT AS pos, round(value / sqrt(sum(value * value) OVER (PARTITION BY cluster_id)), 6) AS value FROM a""", "embedding")
def _(g: Graph) -> DataFrame:
    return C.centroids(_members(g), g.embedding).withColumn("value", F.round("value", 6))


_COHESION = ", h AS (SELECT x.cluster_id, avg(list_cosine_similarity(u.vector::DOUBLE[], w.vector::DOUBLE[])) AS cohesion FROM m x JOIN m y ON x.cluster_id = y.cluster_id AND x.thought_id < y.thought_id JOIN embedding u ON u.owner_id = x.thought_id JOIN embedding w ON w.owner_id = y.thought_id GROUP BY 1)"


@query("d9_cohesion", _CLUSTERS + _COHESION + " SELECT cluster_id, round(cohesion, 6) AS cohesion FROM h", "embedding")
def _(g: Graph) -> DataFrame:
    return C.cohesion(_members(g), g.embedding).withColumn("cohesion", F.round("cohesion", 6))


_TOK = r"list_filter(regexp_split_to_array(translate(lower(concat_ws(' ', {cols})), '" + ACCENTED + "', '" + PLAIN + r"'), '[^\p{{L}}\p{{N}}_-]+'), lambda x: x != '')"


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _key_words(text: str) -> str:
    """DuckDB's form of key_tokens."""
    for marker in ROLE_MARKERS:
        text = f"regexp_replace({text}, '{marker}', ' ', 'g')"
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 3 AND x NOT IN ({_listed(STOP_WORDS)}))"


_NAMES = rf"list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+'), lambda x: (regexp_matches(x, '^[A-Z][A-Za-z0-9]{{2,}}$') AND x NOT IN ({_listed(STARTERS)})) OR regexp_matches(x, '^([0-9]{{4}}|[0-9]+(km|min|s|hr|h|m|kg))$')), regexp_extract_all(concat(content, ' '), '[\p{{L}}\p{{N}}_](\$[0-9]+)[^\p{{L}}\p{{N}}_]', 1))))"
#: A word of the opposites is what stands between characters other than letters, digits, underscores and apostrophes; apostrophes at its ends are none of it.
_WORDS = r"list_transform(regexp_extract_all(lower(content), '[\p{L}\p{N}_'']+'), lambda x: trim(x, chr(39)))"
_SIDES = ", ".join(f"bool_or(list_has_any({_WORDS}, [{_listed(side)}])) AS s{i}" for i, side in enumerate(side for pair in C.CONTRADICTIONS for side in pair))


@query("m11_gates", _CLUSTERS + _COHESION + f""", r AS (SELECT cluster_id, thought_id, content, content_hash, metadata_json, {_NAMES} AS names FROM m JOIN thought USING (thought_id)),
o AS (SELECT cluster_id, count(*) AS n, count(DISTINCT content_hash) AS d, avg(CASE WHEN NOT (contains(content, '[USER]') OR contains(content, '[ASSISTANT]') OR contains(content, '[SYSTEM]')) AND regexp_matches(lower(content), 'born in 19|born in 20|is a |is the |is an |embracing their') THEN 1.0 ELSE 0.0 END) AS persona,
  avg(CASE WHEN CAST(json_extract({_JSON}, '$.source.is_self') AS VARCHAR) = 'true' THEN 0.0 ELSE 1.0 END) AS external, arg_min(names, thought_id) AS first, {_SIDES} FROM r GROUP BY 1),
q AS (SELECT r.cluster_id, sum(CASE WHEN list_has_any(names, first) THEN 1 ELSE 0 END) AS shared FROM r JOIN o USING (cluster_id) GROUP BY 1)
SELECT cluster_id, CASE WHEN d < n THEN 'duplicate' WHEN persona >= 0.75 THEN 'persona' WHEN (s0 AND s1) OR (s2 AND s3) OR (s4 AND s5) THEN 'contradiction' WHEN cohesion < 0.4 THEN 'cohesion' WHEN external < 0.95 THEN 'external' WHEN len(first) > 0 AND shared::DOUBLE / n < 0.6 THEN 'entities' END AS rejected_by
FROM o JOIN h USING (cluster_id) JOIN q USING (cluster_id)""", "thought", "embedding")
def _(g: Graph) -> DataFrame:
    member = _members(g)
    return C.gates(member, g.thought, C.cohesion(member, g.embedding))


_BY_SOURCE = "SELECT source AS cluster_id, thought_id, content FROM thought"


@query("d14_keywords", f""", x AS (SELECT cluster_id, thought_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT cluster_id, thought_id, {_key_words('content')} AS w FROM ({_BY_SOURCE}))), n AS (SELECT cluster_id, word, count(*) AS n, min({{'t': thought_id, 'p': pos}}) AS first FROM x GROUP BY 1, 2)
SELECT cluster_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS rank FROM n) WHERE rank <= 5""", "thought")
def _(g: Graph) -> DataFrame:
    return C.keywords(g.thought.withColumnRenamed("source", "cluster_id"), 5)


_TFIDF = f""", x AS (SELECT cluster_id, thought_id, {_key_words('content')} AS w FROM ({_BY_SOURCE})),
g AS (SELECT cluster_id, thought_id, unnest(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase FROM x),
d AS (SELECT phrase, count(DISTINCT thought_id) AS df FROM g GROUP BY 1), t AS (SELECT cluster_id, phrase, count(*) AS tf FROM g GROUP BY 1, 2),
s AS (SELECT cluster_id, phrase, tf * ln((1 + (SELECT count(*) FROM x)) / (1 + df)) AS score FROM t JOIN d USING (phrase)),
top AS (SELECT cluster_id, phrase, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, phrase) AS rank FROM s) WHERE rank <= 5)"""


def _phrases(g: Graph) -> DataFrame:
    return C.tfidf(g.thought.withColumnRenamed("source", "cluster_id"), g.thought, 5)


@query("d12_tfidf", _TFIDF + " SELECT cluster_id, phrase, score FROM top", "thought")
def _(g: Graph) -> DataFrame:
    return _phrases(g)


_COMMON = ", c AS (SELECT lower(phrase) AS phrase, count(DISTINCT cluster_id) AS clusters FROM top GROUP BY 1)"


@query("d13_phrase_df", _TFIDF + _COMMON + " SELECT phrase, clusters FROM c", "thought")
def _(g: Graph) -> DataFrame:
    return C.phrase_frequency(_phrases(g))


@query("f18_boilerplate", _TFIDF + _COMMON + """, k AS (SELECT t.*, clusters / 20.0 <= 0.05 AS good FROM top t JOIN c ON lower(t.phrase) = c.phrase)
SELECT cluster_id, phrase, score FROM (SELECT *, sum(good::INT) OVER (PARTITION BY cluster_id) AS kept FROM k) WHERE good OR kept < 1""", "thought")
def _(g: Graph) -> DataFrame:
    return C.without_boilerplate(_phrases(g), 20, share=0.05)


@query("f19_generic", _TFIDF + rf" SELECT phrase, regexp_matches(phrase, '(?i)^\s*({'|'.join(C.GENERIC_LEADERS)})\s+[\p{{L}}\p{{N}}_]') AS generic FROM (SELECT DISTINCT phrase FROM top UNION SELECT concat('Some ', phrase) FROM top)", "thought")
def _(g: Graph) -> DataFrame:
    found = _phrases(g).select("phrase").distinct()
    return found.union(found.select(F.concat(F.lit("Some "), "phrase"))).distinct().select("phrase", C.generic(F.col("phrase")).alias("generic"))


_CUT = "CASE WHEN length(content) <= 150 THEN content ELSE rtrim(CASE WHEN strpos(substr(content, 1, 147), ' ') > 0 AND length(regexp_extract(substr(content, 1, 147), '(?s)^(.*) [^ ]*$', 1)) > 0 THEN regexp_extract(substr(content, 1, 147), '(?s)^(.*) [^ ]*$', 1) ELSE substr(content, 1, 147) END) || '...' END"


@query("f17_truncate", f"SELECT thought_id, {_CUT} AS excerpt FROM thought", "thought")
def _(g: Graph) -> DataFrame:
    return g.thought.select("thought_id", truncated(F.col("content"), 150).alias("excerpt"))


_SUMMARY = _CLUSTERS + rf""", r AS (SELECT m.cluster_id, t.*, {_NAMES} AS names FROM m JOIN thought t USING (thought_id)),
q AS (SELECT cluster_id, string_agg(thought_id || ':' || {_CUT}, ' / ' ORDER BY k) AS excerpts FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY priority, created_at DESC NULLS FIRST, thought_id) AS k FROM r) WHERE k <= 5 GROUP BY 1),
u AS (SELECT cluster_id, string_agg(x, ',' ORDER BY x) AS entities FROM (SELECT DISTINCT cluster_id, unnest(names) AS x FROM r) GROUP BY 1),
su AS (SELECT cluster_id, count(*) AS members, substr(sha256('["' || string_agg(thought_id, '", "' ORDER BY thought_id) || '"]'), 1, 16) AS source_hash, min(priority) AS priority, min(created_at) AS first_at, max(created_at) AS last_at,
  CASE WHEN count(*) = count(valid_from) THEN min(valid_from) END AS valid_from, CASE WHEN count(*) = count(valid_until) THEN max(valid_until) END AS valid_until, any_value(excerpts) AS excerpts, coalesce(any_value(entities), '') AS entities,
  coalesce(round((epoch(max(created_at)) - epoch(min(created_at))) / 86400, 2), 0) AS span_days FROM r JOIN q USING (cluster_id) LEFT JOIN u USING (cluster_id) GROUP BY cluster_id)"""


@query("m14_summaries", _SUMMARY + " SELECT * FROM su", "thought", "embedding")
def _(g: Graph) -> DataFrame:
    out = C.summaries(_members(g), g.thought).drop("member_ids")
    return out.withColumn("entities", F.array_join("entities", ",")).withColumn("excerpts", F.array_join(F.transform("excerpts", lambda x: F.concat(x["thought_id"], F.lit(":"), x["excerpt"])), " / "))


def _reflections(g: Graph) -> DataFrame:
    member = _members(g)
    rows = member.join(g.thought.select("thought_id", "content"), "thought_id")
    return C.reflections(C.summaries(member, g.thought), C.keywords(rows, 10), C.tfidf(rows, g.thought), g.thought, CYCLE, _NOW)


_KW = f""", kx AS (SELECT cluster_id, thought_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT cluster_id, thought_id, {_key_words('content')} AS w FROM r)), kn AS (SELECT cluster_id, word, count(*) AS n, min({{'t': thought_id, 'p': pos}}) AS first FROM kx GROUP BY 1, 2),
kr AS (SELECT cluster_id, word, n, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS rank FROM kn), kw AS (SELECT cluster_id, string_agg(word, ', ' ORDER BY n DESC, word) AS words FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, word) AS place FROM kr WHERE rank <= 10) WHERE place <= 3 GROUP BY 1)"""


@query("m16_reflections", _SUMMARY + _KW + " SELECT concat('r', source_hash) AS thought_id, substr(concat('REFLECTION [', words, ']'), 1, 200) AS essence, concat('dreaming:', source_hash) AS source, valid_from, valid_until, members::INT AS members FROM su JOIN kw USING (cluster_id)", "thought", "embedding")
def _(g: Graph) -> DataFrame:
    return _reflections(g).select("thought_id", "essence", "source", "valid_from", "valid_until", F.get_json_object("content", "$.member_count").cast("int").alias("members"))


@query("m16_lineage", _CLUSTERS + """, x AS (SELECT cluster_id, concat('r', substr(sha256('["' || string_agg(thought_id, '", "' ORDER BY thought_id) || '"]'), 1, 16)) AS id FROM m GROUP BY 1)
SELECT id AS from_thought_id, thought_id AS to_thought_id, 1.0::DOUBLE AS weight FROM m JOIN x USING (cluster_id)""", "embedding")
def _(g: Graph) -> DataFrame:
    summary = _members(g).groupBy("cluster_id").agg(F.array_sort(F.collect_list("thought_id")).alias("member_ids"))
    ids = F.concat(F.lit("r"), F.substring(F.sha2(F.concat(F.lit('["'), F.array_join("member_ids", '", "'), F.lit('"]')), 256), 1, 16))
    return C.lineage(summary.select(ids.alias("thought_id"), "member_ids"), CYCLE).select("from_thought_id", "to_thought_id", "weight")


@query("e1_top_neighbours", """, u AS (SELECT edge_id, from_thought_id AS thought_id, to_thought_id AS other, weight FROM edge UNION ALL SELECT edge_id, to_thought_id, from_thought_id, weight FROM edge)
SELECT thought_id, other, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY thought_id ORDER BY weight DESC, edge_id, other) AS rank FROM u) WHERE rank <= 3""", "edge")
def _(g: Graph) -> DataFrame:
    return R.top_neighbours(g.edge, 3).select("thought_id", "other", "weight", F.col("rank").cast("long").alias("rank"))


_BM25 = f""", x AS (SELECT thought_id, priority, updated_cycle, thought_type, source, metadata_json, {_LIVE} AS ok, {_TOK.format(cols='essence, content')} AS w FROM thought),
f AS (SELECT thought_id, ok, len(w) AS dl, {', '.join(f"len(list_filter(w, lambda y: y = '{t}')) AS f{i}" for i, t in enumerate(_TERMS))} FROM x),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f"sum((f{i} > 0)::INT) AS df{i}" for i in range(len(_TERMS)))} FROM f),
bm AS (SELECT thought_id, {' + '.join(f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(_TERMS)))} AS score FROM f, st WHERE ok AND {' + '.join(f'f{i}' for i in range(len(_TERMS)))} > 0)"""


@query("l1_bm25", _BM25 + " SELECT thought_id, round(score, 6) AS score FROM bm ORDER BY score DESC, thought_id LIMIT 50", "thought")
def _(g: Graph) -> DataFrame:
    return R.ranked(R.bm25(g.thought, _TERMS, live(_NOW)), 50).withColumn("score", F.round("score", 6))


_FOUND = ", ls AS (SELECT thought_id, " + _TOK.format(cols="essence").replace("concat_ws(' ', essence)", "essence") + " AS e, " + _TOK.format(cols="content").replace("concat_ws(' ', content)", "content") + f" AS c FROM thought WHERE {_LIVE})"
_PAIR = "(len(list_filter(range(1, len({0})), lambda i: {0}[i] = 'creative' AND {0}[i + 1] = 'commons')) > 0)"


def _expert(name: str, text: str, sql: str) -> None:
    """Which rows a keyword expression matches: their scores are l1's."""
    @query(name, _FOUND + f" SELECT thought_id FROM ls WHERE {sql}", "thought")
    def _(g: Graph) -> DataFrame:
        return R.bm25(g.thought, text, live(_NOW)).select("thought_id")


_expert("l2_boolean", "license AND rely OR thand NOT hat", "(list_contains(e, 'license') OR list_contains(c, 'license')) AND (list_contains(e, 'rely') OR list_contains(c, 'rely')) OR (list_contains(e, 'thand') OR list_contains(c, 'thand')) AND NOT (list_contains(e, 'hat') OR list_contains(c, 'hat'))")
_expert("l2_phrase", '"creative commons" OR "under the apache"', _PAIR.format("e") + " OR " + _PAIR.format("c") + " OR " + " OR ".join(f"len(list_filter(range(1, len({x}) - 1), lambda i: {x}[i] = 'under' AND {x}[i + 1] = 'the' AND {x}[i + 2] = 'apache')) > 0" for x in "ec"))
_expert("l2_prefix_column", "content:licen* AND essence:a* NOT content:apache", "len(list_filter(c, lambda x: starts_with(x, 'licen'))) > 0 AND len(list_filter(e, lambda x: starts_with(x, 'a'))) > 0 AND NOT list_contains(c, 'apache')")
_expert("l2_parentheses", "(apache OR mit) AND license", "(list_has_any(e, ['apache', 'mit']) OR list_has_any(c, ['apache', 'mit'])) AND (list_contains(e, 'license') OR list_contains(c, 'license'))")
_expert("l3_malformed", "rely AND", "list_has_any(e, ['rely', 'and']) OR list_has_any(c, ['rely', 'and'])")
_expert("f3_bare_text", "what's Apache's license?", "list_has_any(e, ['what', 's', 'apache', 'license']) OR list_has_any(c, ['what', 's', 'apache', 'license'])")


def _vector(g: Graph) -> list[float]:
    return g.embedding.filter(F.col("owner_id") == _OWNER).select("vector").first()[0]


_KNN = f", kn AS (SELECT owner_id AS thought_id, list_cosine_similarity(vector::DOUBLE[], (SELECT vector FROM embedding WHERE owner_id = '{_OWNER}')::DOUBLE[]) AS score FROM embedding WHERE owner_id IN (SELECT thought_id FROM thought WHERE {_LIVE}))"


@query("g3_knn", _KNN + " SELECT thought_id, round(score, 6) AS score FROM kn WHERE score >= 0 ORDER BY kn.score DESC, thought_id LIMIT 20", "thought", "embedding")
def _(g: Graph) -> DataFrame:
    return R.ranked(R.knn(g.embedding, g.thought.filter(live(_NOW)), _vector(g)), 20).withColumn("score", F.round("score", 6))


_POOL = _BM25 + _KNN + """, fp AS (SELECT * FROM bm ORDER BY score DESC, thought_id LIMIT 50), vp AS (SELECT * FROM kn WHERE score >= 0 ORDER BY score DESC, thought_id LIMIT 50),
mm AS (SELECT min(score) AS lo, max(score) AS hi FROM fp), pool AS (SELECT coalesce(a.thought_id, b.thought_id) AS thought_id, coalesce(CASE WHEN hi = lo THEN 0.5 ELSE (a.score - lo) / (hi - lo) END, 0) AS fts, coalesce(b.score, 0) AS cos
  FROM (SELECT fp.*, lo, hi FROM fp, mm) a FULL OUTER JOIN vp b ON a.thought_id = b.thought_id)"""
_BASE = "0.30 * fts + 0.55 * cos + 0.10 * exp(-ln(2) * greatest(0, 100 - updated_cycle) / 50.0) + 0.05 * CASE priority WHEN 'P1' THEN 1.0 WHEN 'P2' THEN 0.6 WHEN 'P3' THEN 0.3 ELSE 0.0 END"


def hybrid(g: Graph, **more) -> DataFrame:
    return R.hybrid(g.thought, g.embedding, g.edge, _TERMS, _vector(g), cycle=CYCLE, eligible=live(_NOW), **more)


@query("l8_hybrid", _POOL + f" SELECT thought_id, round({_BASE}, 6) AS score FROM pool JOIN thought USING (thought_id) ORDER BY {_BASE} DESC, thought_id LIMIT 10", "thought", "embedding")
def l8_hybrid(g: Graph) -> DataFrame:
    return hybrid(g).withColumn("score", F.round("score", 6))


_NEAR = """, u AS (SELECT edge_id, from_thought_id AS thought_id, to_thought_id AS other, weight FROM edge UNION ALL SELECT edge_id, to_thought_id, from_thought_id, weight FROM edge),
ne AS (SELECT u2.thought_id, sum(weight * greatest(fts, cos) * 0.5) AS near FROM (SELECT *, row_number() OVER (PARTITION BY thought_id ORDER BY weight DESC, edge_id, other) AS rank FROM u) u2 JOIN pool ON pool.thought_id = u2.other WHERE rank <= 5 GROUP BY 1)"""


@query("l12_graph", _POOL + _NEAR + f", sc AS (SELECT thought_id, (0.30 / 1.1) * fts + (0.55 / 1.1) * cos + (0.10 / 1.1) * exp(-ln(2) * greatest(0, 100 - updated_cycle) / 50.0) + (0.05 / 1.1) * CASE priority WHEN 'P1' THEN 1.0 WHEN 'P2' THEN 0.6 WHEN 'P3' THEN 0.3 ELSE 0.0 END + (0.1 / 1.1) * coalesce(near, 0) AS score FROM pool JOIN thought USING (thought_id) LEFT JOIN ne USING (thought_id)) SELECT thought_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, thought_id LIMIT 10", "thought", "embedding", "edge")
def _(g: Graph) -> DataFrame:
    return hybrid(g, weights={"fts": 0.30, "vector": 0.55, "recency": 0.10, "priority": 0.05, "graph": 0.10}).withColumn("score", F.round("score", 6))


_H50 = _POOL + f", hy AS (SELECT thought_id, thought_type, source, {_BASE} AS score FROM pool JOIN thought USING (thought_id) ORDER BY score DESC, thought_id LIMIT 50)"


def _h50(g: Graph) -> DataFrame:
    return hybrid(g, top_k=50).join(g.thought.select("thought_id", "thought_type", "source"), "thought_id")


@query("l13_expansion", _H50 + f""", pa AS (SELECT * FROM hy WHERE thought_type = 'REFLECTION' ORDER BY score DESC, thought_id LIMIT 5),
o AS (SELECT e.*, pa.score AS parent, count(*) OVER (PARTITION BY from_thought_id) AS n, row_number() OVER (PARTITION BY from_thought_id ORDER BY e.weight DESC, edge_id) AS rank FROM edge e JOIN pa ON pa.thought_id = e.from_thought_id WHERE edge_type = 'CONSOLIDATED_FROM'),
al AS (SELECT thought_id, score FROM hy UNION ALL SELECT o.to_thought_id, parent * 0.7 * weight FROM o JOIN (SELECT * FROM thought WHERE {_LIVE}) t ON t.thought_id = o.to_thought_id WHERE t.thought_type = 'OBSERVATION' AND n <= 50 AND rank <= 20)
SELECT thought_id, round(max(score), 6) AS score FROM al GROUP BY 1""", "thought", "embedding", "edge")
def _(g: Graph) -> DataFrame:
    return R.expand(_h50(g).select("thought_id", "score"), g.thought, g.edge, eligible=live(_NOW)).withColumn("score", F.round("score", 6))


_POOL200 = _POOL.replace("LIMIT 50", "LIMIT 200")
_RECALL = _POOL200.replace('{', '{{').replace('}', '}}') + f""", hy AS (SELECT thought_id, thought_type, {_BASE} AS score FROM pool JOIN thought USING (thought_id)),
pa AS (SELECT * FROM hy WHERE thought_type = 'REFLECTION' ORDER BY score DESC, thought_id LIMIT 5),
o AS (SELECT e.*, pa.score AS parent, count(*) OVER (PARTITION BY from_thought_id) AS n, row_number() OVER (PARTITION BY from_thought_id ORDER BY e.weight DESC, edge_id) AS rank FROM edge e JOIN pa ON pa.thought_id = e.from_thought_id WHERE edge_type = 'CONSOLIDATED_FROM'),
al AS (SELECT thought_id, score FROM hy UNION ALL SELECT o.to_thought_id, parent * 0.7 * weight FROM o JOIN (SELECT * FROM thought WHERE {_LIVE}) t ON t.thought_id = o.to_thought_id WHERE t.thought_type = 'OBSERVATION' AND n <= 50 AND rank <= 20),
ex AS (SELECT thought_id, max(score) AS score FROM al GROUP BY 1), bo AS (SELECT ex.thought_id, t.thought_type, ex.score * CASE WHEN t.thought_type = 'REFLECTION' THEN {{boost}} ELSE 1 END AS score, coalesce(json_extract_string({_JSON}, '$.owner') || '|' || json_extract_string({_JSON}, '$.rank'), t.thought_id) AS unit FROM ex JOIN thought t USING (thought_id) {{where}}),
co AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, thought_id) AS k FROM bo) WHERE k <= {{most}}),
ca AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thought_type = 'REFLECTION' ORDER BY score DESC, thought_id) AS z FROM co) WHERE thought_type != 'REFLECTION' OR z <= 3)
SELECT row_number() OVER (ORDER BY score DESC, thought_id)::INT AS rank, thought_id, round(score, 6) AS score FROM (SELECT * FROM ca ORDER BY score DESC, thought_id LIMIT 10)"""


def _recall(name: str, boost: float, most: int, where: str = "", **how) -> None:
    """The whole search: fusion over pools of 200, expansion, boost, collapse by two metadata keys, cap of three reflections, ten rows."""
    @query(name, _RECALL.format(boost=boost, most=most, where=where), "thought", "embedding", "edge")
    def _(g: Graph) -> DataFrame:
        found = R.search(g.thought, g.embedding, g.edge, list(_TERMS), _vector(g), now=_NOW, cycle=CYCLE, collapse_key=["$.owner", "$.rank"], collapse_max=most, reflection_boost=boost, **how)
        return found.rows.withColumn("score", F.round("score", 6))


_recall("l17_recall", 1.0, 1)
_recall("l14_boost", 1.5, 2)
_recall("l14_without_reflections", 1.0, 1, "WHERE t.thought_type != 'REFLECTION'", include_reflections=False)


@query("l15_evicted", _RECALL.format(boost=2.0, most=2, where="").partition("ca AS (")[0].rstrip(", \n") + " SELECT greatest(0, count(*) - 3)::INT AS evicted FROM (SELECT * FROM co ORDER BY score DESC, thought_id LIMIT 10) WHERE thought_type = 'REFLECTION'", "thought", "embedding", "edge")
def _(g: Graph) -> DataFrame:
    found = R.search(g.thought, g.embedding, g.edge, list(_TERMS), _vector(g), now=_NOW, cycle=CYCLE, collapse_key=["$.owner", "$.rank"], collapse_max=2, reflection_boost=2.0)
    return g.spark.createDataFrame([(found.reflections_evicted,)], "evicted int")


@query("l19_backends", "SELECT unnest(['fts', 'vector', 'recency', 'priority']) AS backend")
def _(g: Graph) -> DataFrame:
    found = R.search(g.thought, g.embedding, g.edge, list(_TERMS), _vector(g), now=_NOW, cycle=CYCLE, expansion=False)
    return g.spark.createDataFrame([(x,) for x in sorted(found.backends_used)], "backend string")


def _collapse(name: str, most: int) -> None:
    @query(name, _H50 + f" SELECT thought_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, thought_id) AS rank FROM hy) WHERE rank <= {most}", "thought", "embedding")
    def _(g: Graph) -> DataFrame:
        return R.collapse(_h50(g), F.col("source"), most).select("thought_id", F.round("score", 6).alias("score"))


_collapse("e2_collapse", 1)
_collapse("e2_collapse_max2", 2)


@query("e3_reflection_cap", _H50 + " SELECT thought_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY thought_type = 'REFLECTION' ORDER BY score DESC, thought_id) AS rank FROM hy) x WHERE thought_type != 'REFLECTION' OR rank <= 2 ORDER BY x.score DESC, thought_id LIMIT 20", "thought", "embedding")
def _(g: Graph) -> DataFrame:
    return R.cap_reflections(_h50(g), 20, 0.1).select("thought_id", F.round("score", 6).alias("score"))


@query("h2_fusion_pool", _POOL + " SELECT thought_id, round(fts, 6) AS fts, round(cos, 6) AS cos FROM pool", "thought", "embedding")
def _(g: Graph) -> DataFrame:
    fts = R.minmax(R.ranked(R.bm25(g.thought, _TERMS, live(_NOW)), 50), "score").withColumnRenamed("score", "fts")
    vec = R.ranked(R.knn(g.embedding, g.thought.filter(live(_NOW)), _vector(g)), 50).withColumnRenamed("score", "cos")
    return fts.join(vec, "thought_id", "full_outer").fillna(0.0, ["fts", "cos"]).select("thought_id", F.round("fts", 6).alias("fts"), F.round("cos", 6).alias("cos"))


@query("l16_fallback", f"SELECT thought_id, 0.0::DOUBLE AS score FROM thought WHERE {_LIVE} ORDER BY updated_cycle DESC, thought_id LIMIT 10", "thought")
def _(g: Graph) -> DataFrame:
    return R.fallback(g.thought, live(_NOW), 10)


@query("l18_reflections", _KNN + f" SELECT t.thought_id, round(0.9 * coalesce(kn.score, 0) + 0.1 * exp(-ln(2) * greatest(0, 100 - updated_cycle) / 50.0), 6) AS score FROM thought t LEFT JOIN kn ON kn.thought_id = t.thought_id WHERE {_LIVE.replace('thought_type', 't.thought_type')} AND t.thought_type = 'REFLECTION' AND lifecycle_status = 'ACTIVE'", "thought", "embedding")
def _(g: Graph) -> DataFrame:
    return R.reflections_only(g.thought, g.embedding, _vector(g), live(_NOW), CYCLE).withColumn("score", F.round("score", 6))


@query("f1_hash_dedup", "SELECT content_hash, count(*) AS copies FROM thought GROUP BY 1 HAVING count(*) > 1", "thought")
def _(g: Graph) -> DataFrame:
    return g.thought.groupBy("content_hash").agg(F.count("*").alias("copies")).filter("copies > 1")


@query("f6_cosine", "SELECT x.embedding_id, round(list_cosine_similarity(x.vector::DOUBLE[], y.vector::DOUBLE[]), 6) AS sim FROM embedding x JOIN embedding y ON y.embedding_id = concat('v', lpad(cast((cast(substr(x.embedding_id, 2) AS BIGINT) + 1) AS VARCHAR), 9, '0'))", "embedding")
def _(g: Graph) -> DataFrame:
    y = g.embedding.select(F.concat(F.lit("v"), F.lpad((F.substring("embedding_id", 2, 9).cast("long") - 1).cast("string"), 9, "0")).alias("embedding_id"), F.col("vector").alias("other"))
    return g.embedding.join(y, "embedding_id").select("embedding_id", F.round(cosine(F.col("vector"), F.col("other")), 6).alias("sim"))


@query("f7_cycle_recency", "SELECT thought_id, round(exp(-ln(2) * greatest(0, 60 - updated_cycle) / 50.0), 6) AS recency FROM thought", "thought")
def _(g: Graph) -> DataFrame:
    return g.thought.select("thought_id", F.round(cycle_recency(60, 50), 6).alias("recency"))


@query("f8_tx_recency", f"SELECT thought_id, round(coalesce(exp(-ln(2) * greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(coalesce(updated_at, created_at))) / 604800.0), 0), 6) AS recency FROM thought", "thought")
def _(g: Graph) -> DataFrame:
    return g.thought.select("thought_id", F.round(instant_recency(NOW, 604_800), 6).alias("recency"))


@query("f9_priority", "SELECT thought_id, CASE priority WHEN 'P1' THEN 1.0::DOUBLE WHEN 'P2' THEN 0.6 WHEN 'P3' THEN 0.3 ELSE 0.0 END AS boost FROM thought", "thought")
def _(g: Graph) -> DataFrame:
    return g.thought.select("thought_id", priority_boost().alias("boost"))


_SIGNALS = {"recency": "exp(-0.01 * greatest(0, 100 - updated_cycle))", "staleness": "least(1.0, (updated_cycle - created_cycle) / 100.0)", "confirmation": "least(1.0, confirmation_count / 5.0)", "confidence": "coalesce(confidence, 0.5)", "frequency": "least(1.0, access_count / 10.0)", "action_outcome": "coalesce(action_outcome_score, 0.0)"}


@query("f10_signals", "SELECT thought_id, " + ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in _SIGNALS.items()) + " FROM thought", "thought")
def _(g: Graph) -> DataFrame:
    return g.thought.select("thought_id", *[F.round(v, 6).alias(k) for k, v in signals(CYCLE).items()])


@query("f5_tokens", f"SELECT thought_id, len(w)::INT AS n, len(list_distinct(w))::INT AS n_distinct FROM (SELECT thought_id, {_TOK.format(cols='essence, content')} AS w FROM thought)", "thought")
def _(g: Graph) -> DataFrame:
    t = tokens(F.col("essence"), F.col("content"))
    return g.thought.select("thought_id", F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("f12_split_paragraph", "SELECT doc_id, (p - 1)::INT AS pos, x AS segment FROM (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS p FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 1) AS s FROM documents) WHERE len(s) >= 2)")
def _(g: Graph) -> DataFrame:
    return g.base("documents").select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("pos", "segment"))


@query("f12_split_window", "SELECT doc_id, i::INT AS pos, substr(text, 1 + 300 * i, 400) AS segment FROM (SELECT doc_id, text, unnest(range((length(text) - 400 + 299) // 300 + 1)) AS i FROM documents WHERE length(text) > 400)")
def _(g: Graph) -> DataFrame:
    return g.base("documents").select("doc_id", F.posexplode(char_windows(F.col("text"), 400, 300)).alias("pos", "segment"))


@query("f12_segments", "SELECT doc_id, i::INT AS pos, substr(text, 1 + 300 * i, 400) AS content, (300 * i)::INT AS start, least(300 * i + 400, length(text))::INT AS \"end\" FROM (SELECT doc_id, text, unnest(range((length(text) - 400 + 299) // 300 + 1)) AS i FROM documents WHERE length(text) > 400)")
def _(g: Graph) -> DataFrame:
    return g.base("documents").select("doc_id", F.posexplode(segments(F.col("text"), "window")).alias("pos", "s")).select("doc_id", "pos", "s.content", "s.start", "s.end")


@query("f12_split_words", r"SELECT doc_id, i::INT AS pos, array_to_string(y[1 + 40 * i:least(49 + 40 * i, len(w) - 1)], '') || w[least(50 + 40 * i, len(w))] AS segment FROM (SELECT doc_id, w, list_transform(range(1, len(w) + 1), lambda k: w[k] || p[k + 1]) AS y, unnest(range((len(w) - 50 + 39) // 40 + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w, regexp_split_to_array(text, '\S+') AS p FROM documents) WHERE len(w) > 50)")
def _(g: Graph) -> DataFrame:
    return g.base("documents").select("doc_id", F.posexplode(word_windows(F.col("text"), 50, 40)).alias("pos", "segment"))


@query("f16_entities", f"SELECT thought_id, array_to_string({_NAMES}, ',') AS entities FROM thought", "thought")
def _(g: Graph) -> DataFrame:
    return g.thought.select("thought_id", F.array_join(entities(F.col("content")), ",").alias("entities"))


@query("k2_dedup", "SELECT content_hash, min(thought_id) AS thought_id, arg_min(confirmation_count, thought_id) + count(*) - 1 AS confirmation_count FROM thought GROUP BY 1", "thought")
def _(g: Graph) -> DataFrame:
    return S.dedupe(g.thought)


@query("k3_get_or_create", """, k AS (SELECT content_hash, min(thought_id) AS known FROM thought WHERE created_cycle < 25 GROUP BY 1), n AS (SELECT content_hash, min(thought_id) AS first FROM thought WHERE created_cycle >= 25 GROUP BY 1)
SELECT t.content_hash, coalesce(known, first) AS thought_id, known IS NULL AND t.thought_id = first AS created FROM thought t JOIN n USING (content_hash) LEFT JOIN k USING (content_hash) WHERE created_cycle >= 25""", "thought")
def _(g: Graph) -> DataFrame:
    return S.get_or_create(g.thought.filter("created_cycle < 25"), g.thought.filter("created_cycle >= 25"))


@query("k1_create_deduplicate", """, o AS (SELECT * FROM thought WHERE created_cycle < 25), n AS (SELECT *, min(thought_id) OVER (PARTITION BY content_hash) AS first FROM thought WHERE created_cycle >= 25), k AS (SELECT content_hash, min(thought_id) AS known FROM o GROUP BY 1),
h AS (SELECT coalesce(known, first) AS thought_id, count(*) AS more FROM n LEFT JOIN k USING (content_hash) WHERE known IS NOT NULL OR n.thought_id != first GROUP BY 1)
SELECT thought_id, confirmation_count + coalesce(more, 0) AS confirmation_count, expires_at FROM (SELECT thought_id, confirmation_count, expires_at FROM o UNION ALL SELECT thought_id, confirmation_count, coalesce(expires_at, TIMESTAMP '2024-02-15 01:00:00') FROM n WHERE thought_id = first AND content_hash NOT IN (SELECT content_hash FROM k)) LEFT JOIN h USING (thought_id)""", "thought")
def _(g: Graph) -> DataFrame:
    out, _conflict = S.create(g.thought.filter("created_cycle < 25"), g.thought.filter("created_cycle >= 25"), _NOW, deduplicate=True, default_ttl_s=3600)
    return out.select("thought_id", "confirmation_count", "expires_at")


@query("k1_conflicts", "SELECT thought_id FROM thought WHERE created_cycle BETWEEN 20 AND 24", "thought")
def _(g: Graph) -> DataFrame:
    return S.create(g.thought.filter("created_cycle < 25"), g.thought.filter("created_cycle >= 20"), _NOW)[1].select("thought_id")


@query("k6_remember", "SELECT concat('m', doc_id) AS thought_id, substr(text, 1, 200) AS essence, sha256(text) AS content_hash, 'NOTE' AS thought_type, 'P3' AS priority, 'ACTIVE' AS lifecycle_status, cast(0 AS BIGINT) AS created_cycle FROM documents")
def _(g: Graph) -> DataFrame:
    texts = g.base("documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("thought_id"), "text")
    return S.remembered(texts).select("thought_id", "essence", "content_hash", "thought_type", "priority", "lifecycle_status", "created_cycle")


@query("k9_restore", "SELECT thought_id, CASE WHEN lifecycle_status = 'ARCHIVED' AND priority = 'P2' THEN 'ACTIVE' ELSE lifecycle_status END AS lifecycle_status, CASE WHEN lifecycle_status != 'ARCHIVED' OR priority != 'P2' THEN archived_at END AS archived_at, revision + (lifecycle_status = 'ARCHIVED' AND priority = 'P2')::INT AS revision FROM thought", "thought")
def _(g: Graph) -> DataFrame:
    return S.restore(g.thought, g.thought.filter("priority = 'P2'").select("thought_id"))[0].select("thought_id", "lifecycle_status", "archived_at", "revision")


@query("k13_create_edges", """, n AS (SELECT 'n' || edge_id AS edge_id, to_thought_id AS a, from_thought_id AS b, edge_type, weight FROM edge), t AS (SELECT thought_id FROM thought WHERE lifecycle_status = 'ACTIVE'),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, edge_type ORDER BY edge_id) AS nth FROM n)
SELECT edge_id, CASE WHEN a NOT IN (FROM t) OR b NOT IN (FROM t) THEN 'endpoint' WHEN nth > 1 OR EXISTS (SELECT 1 FROM edge e WHERE e.from_thought_id = a AND e.to_thought_id = b AND e.edge_type = r.edge_type) THEN 'duplicate' END AS reason FROM r""", "thought", "edge")
def _(g: Graph) -> DataFrame:
    new = g.edge.select(F.concat(F.lit("n"), "edge_id").alias("edge_id"), F.col("to_thought_id").alias("from_thought_id"), F.col("from_thought_id").alias("to_thought_id"), "edge_type", "weight")
    out, bad = S.create_edges(g.edge, new, g.thought.filter("lifecycle_status = 'ACTIVE'"))
    return out.filter(F.startswith("edge_id", F.lit("n"))).select("edge_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("edge_id", "reason"))


@query("k15_update_actions", """, c AS (SELECT action_id, status, CASE intent WHEN 'click' THEN 'EXECUTING' WHEN 'view' THEN 'CONFIRMED' ELSE 'FAILED' END AS new FROM action)
SELECT action_id, CASE WHEN status = new OR (status = 'PLANNED' AND new IN ('EXECUTING', 'BLOCKED')) OR (status = 'EXECUTING' AND new IN ('CONFIRMED', 'FAILED')) OR (status = 'BLOCKED' AND new = 'PLANNED') THEN new ELSE status END AS status FROM c""", "action")
def _(g: Graph) -> DataFrame:
    new = F.when(F.col("intent") == "click", "EXECUTING").when(F.col("intent") == "view", "CONFIRMED").otherwise("FAILED")
    return S.update_actions(g.action, g.action.select("action_id", new.alias("status"), F.lit(None).cast("string").alias("verification_status")))[0].select("action_id", "status")


@query("k15_outcome_of_records", "SELECT thought_id, round(score, 6) AS score FROM thought LEFT JOIN (SELECT source_thought_id, avg(CASE WHEN status = 'FAILED' THEN 0.0 WHEN status = 'CONFIRMED' THEN CASE verification_status WHEN 'CONFIRMED' THEN 1.0 WHEN 'FAILED' THEN 0.0 ELSE 0.5 END END) AS score FROM action GROUP BY 1) a ON source_thought_id = thought_id", "thought", "action")
def _(g: Graph) -> DataFrame:
    return g.thought.select("thought_id").join(S.outcomes(g.action).withColumnRenamed("source_thought_id", "thought_id"), "thought_id", "left").select("thought_id", F.round("score", 6).alias("score"))


@query("k4_upsert", """, d AS (SELECT * FROM thought WHERE thought_id < 'd000000600'), o AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY thought_id) AS nth FROM d), n AS (SELECT content_hash, concat('n', max(thought_id)) AS id, 'P1' AS priority, 0.9::DOUBLE AS confidence FROM thought WHERE thought_id >= 'd000000400' GROUP BY 1)
SELECT coalesce(o.thought_id, n.id) AS thought_id, coalesce(o.content_hash, n.content_hash) AS content_hash, coalesce(n.priority, o.priority) AS priority, coalesce(n.confidence, o.confidence) AS confidence, o.source FROM o FULL OUTER JOIN n ON o.content_hash = n.content_hash AND o.nth = 1""", "thought")
def _(g: Graph) -> DataFrame:
    new = g.thought.filter("thought_id >= 'd000000400'").select("content_hash", F.concat(F.lit("n"), "thought_id").alias("thought_id"), F.lit("P1").alias("priority"), F.lit(0.9).alias("confidence"))
    return S.upsert(g.thought.filter("thought_id < 'd000000600'"), new).select("thought_id", "content_hash", "priority", "confidence", "source")


@query("k7_update_stale", "SELECT thought_id FROM thought WHERE created_cycle % 2 = 1 AND priority = 'P2'", "thought")
def _(g: Graph) -> DataFrame:
    changes = g.thought.filter("priority = 'P2'").select("thought_id", (F.lit(1) + F.col("created_cycle") % 2).cast("long").alias("revision"), F.lit("P1").alias("priority"))
    return S.update(g.thought.select("thought_id", "priority", "revision"), changes, ["priority"])[1].select("thought_id")


@query("k8_invalidate", "SELECT thought_id, CASE WHEN priority = 'P3' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-02-01 00:00:00') THEN TIMESTAMP '2024-02-01 00:00:00' ELSE valid_until END AS valid_until FROM thought", "thought")
def _(g: Graph) -> DataFrame:
    return S.invalidate(g.thought, F.col("priority") == "P3", datetime(2024, 2, 1)).select("thought_id", "valid_until")


@query("k10_cascade", ", x AS (SELECT thought_id FROM thought WHERE lifecycle_status = 'ARCHIVED') SELECT 'action' AS name, count(*) AS n FROM action WHERE source_thought_id NOT IN (FROM x) UNION ALL SELECT 'edge', count(*) FROM edge WHERE from_thought_id NOT IN (FROM x) AND to_thought_id NOT IN (FROM x) UNION ALL SELECT 'embedding', count(*) FROM embedding WHERE owner_id NOT IN (FROM x) UNION ALL SELECT 'thought', count(*) FROM thought WHERE thought_id NOT IN (FROM x)", "thought", "edge", "embedding", "action")
def _(g: Graph) -> DataFrame:
    left = S.delete(g.thought.filter("lifecycle_status = 'ARCHIVED'"), g.thought, g.edge, g.embedding, g.action)
    out = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in sorted(left.items())]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("k11_ttl", f"SELECT thought_id, CASE WHEN pinned THEN 'kept' ELSE 'archived' END AS outcome FROM thought WHERE expires_at <= TIMESTAMP '{NOW}' AND (pinned OR lifecycle_status != 'ARCHIVED')", "thought")
def _(g: Graph) -> DataFrame:
    return S.expire(g.thought, _NOW)


@query("k11_ttl_delete", f"SELECT count(*) FILTER (NOT pinned) AS processed, count(*) FILTER (pinned) AS pinned FROM thought WHERE expires_at <= TIMESTAMP '{NOW}' AND thought_id != 'd000000008'", "thought")
def _(g: Graph) -> DataFrame:
    return S.expired_counts(S.expire(g.thought, _NOW, "delete", exclude="d000000008"))


@query("k12_access_flush", "SELECT thought_id, access_count + coalesce(n, 0) AS access_count, greatest(last_accessed_at, latest) AS last_accessed_at FROM thought LEFT JOIN (SELECT source_thought_id, count(*) AS n, max(created_at) AS latest FROM action GROUP BY 1) a ON source_thought_id = thought_id", "thought", "action")
def _(g: Graph) -> DataFrame:
    return S.touched(g.thought, g.action.select(F.col("source_thought_id").alias("thought_id"), F.col("created_at").alias("at"))).select("thought_id", "access_count", "last_accessed_at")


#: props are JSON objects of one key, so their canonical form is their text.
_CHAIN = """, ch AS (SELECT service, sequence_number, mutation_type, target_id, delta, created_at, cast(NULL AS VARCHAR) AS parent_hash, sha256(concat(sequence_number, '|', mutation_type, '|', target_id, '|', delta, '|')) AS entry_hash FROM journal_input WHERE sequence_number = 1
UNION ALL SELECT j.service, j.sequence_number, j.mutation_type, j.target_id, j.delta, j.created_at, ch.entry_hash, sha256(concat(j.sequence_number, '|', j.mutation_type, '|', j.target_id, '|', j.delta, '|', ch.entry_hash)) FROM ch JOIN journal_input j ON j.service = ch.service AND j.sequence_number = ch.sequence_number + 1)"""


def _chain(g: Graph) -> DataFrame:
    return g.journal_input.join(S.append_journal(g.journal_input, "service"), ["service", "sequence_number"])


@query("k16_journal_append", _CHAIN + " SELECT service, sequence_number, parent_hash, entry_hash FROM ch", "journal_input")
def _(g: Graph) -> DataFrame:
    return S.append_journal(g.journal_input, "service")


@query("e5_journal_verify", _CHAIN + """, ta AS (SELECT service, sequence_number, mutation_type, target_id, CASE WHEN service = 's3' AND sequence_number IN (21, 40) THEN '{}' ELSE delta END AS delta, parent_hash, CASE WHEN service = 's5' AND sequence_number = 30 THEN 'x' ELSE entry_hash END AS entry_hash FROM ch WHERE NOT (service = 's7' AND sequence_number = 11)),
ve AS (SELECT *, entry_hash != sha256(concat(sequence_number, '|', mutation_type, '|', target_id, '|', delta, '|', parent_hash)) OR parent_hash IS DISTINCT FROM lag(entry_hash) OVER (PARTITION BY service ORDER BY sequence_number) AS bad FROM ta)
SELECT service, min(sequence_number) FILTER (bad) AS first_broken, count(*) AS entries, NOT bool_or(bad) AS valid FROM ve GROUP BY 1""", "journal_input")
def _(g: Graph) -> DataFrame:
    """Two changed deltas in one service, a changed hash in another, a missing entry in a third."""
    s, n = F.col("service"), F.col("sequence_number")
    chain = _chain(g).filter(~((s == "s7") & (n == 11)))
    chain = chain.withColumn("delta", F.when((s == "s3") & n.isin(21, 40), "{}").otherwise(F.col("delta"))).withColumn("entry_hash", F.when((s == "s5") & (n == 30), "x").otherwise(F.col("entry_hash")))
    return S.verify_journal(chain, "service", block=16)


@query("g7_read_journal", _CHAIN + " SELECT sequence_number, target_id, entry_hash FROM ch WHERE service = 's2' AND mutation_type = 'CLICK' AND created_at >= TIMESTAMP '2024-01-02 00:00:00' ORDER BY sequence_number LIMIT 20", "journal_input")
def _(g: Graph) -> DataFrame:
    return S.read_journal(_chain(g).filter("service = 's2'"), kind="CLICK", since=datetime(2024, 1, 2), limit=20).select("sequence_number", "target_id", "entry_hash")


_W = {"recency": 0.25, "staleness": 0.20, "confirmation": 0.20, "confidence": 0.15, "frequency": 0.20, "action_outcome": 0.15}
_CAND = "cand AS (SELECT * FROM thought WHERE lifecycle_status = 'ACTIVE')"
_M3 = ", " + _CAND + ", sc AS (SELECT *, (" + " + ".join(f"{w} * {_SIGNALS[k]}" for k, w in _W.items()) + ") / 1.15 AS score FROM cand)"


def _scored(g: Graph) -> DataFrame:
    return C.promotion_scores(g.thought.filter("lifecycle_status = 'ACTIVE'"), CYCLE)


@query("m1_pool", "SELECT thought_id FROM thought WHERE lifecycle_status = 'ACTIVE' ORDER BY updated_cycle DESC, thought_id LIMIT 200", "thought")
def _(g: Graph) -> DataFrame:
    return C.candidates(g.thought).select("thought_id")


@query("h3_cluster_pool", "(SELECT thought_id FROM thought WHERE lifecycle_status = 'ACTIVE' AND thought_type = 'OBSERVATION' ORDER BY updated_cycle DESC, thought_id LIMIT 30) UNION ALL (SELECT thought_id FROM thought WHERE lifecycle_status = 'ACTIVE' AND thought_type = 'BELIEF' ORDER BY updated_cycle DESC, thought_id LIMIT 30)", "thought")
def _(g: Graph) -> DataFrame:
    return C.cluster_pool(g.thought, ("OBSERVATION", "BELIEF"), 30).select("thought_id")


@query("m3_score", _M3 + " SELECT thought_id, round(score, 6) AS score FROM sc", "thought")
def _(g: Graph) -> DataFrame:
    return _scored(g).select("thought_id", F.round("score", 6).alias("score"))


@query("m2_inactive_signals", ", po AS (SELECT *, (0.25 * " + _SIGNALS["recency"] + " + 0.20 * " + _SIGNALS["staleness"] + " + 0.20 * " + _SIGNALS["frequency"] + ") / 0.65 AS score FROM thought WHERE confirmation_count = 0 AND confidence IS NULL AND action_outcome_score IS NULL) SELECT thought_id, round(score, 6) AS score FROM po", "thought")
def _(g: Graph) -> DataFrame:
    pool = g.thought.filter("confirmation_count = 0 AND confidence IS NULL AND action_outcome_score IS NULL")
    return C.promotion_scores(pool, CYCLE).select("thought_id", F.round("score", 6).alias("score"))


@query("j3_custom_signal", _M3.replace(") / 1.15 AS score", " + 0.35 * least(1.0, length(content) / 1000.0)) / 1.5 AS score") + " SELECT thought_id, round(score, 6) AS score FROM sc", "thought")
def _(g: Graph) -> DataFrame:
    long = F.least(F.lit(1.0), F.char_length("content") / F.lit(1000.0))
    return C.promotion_scores(g.thought.filter("lifecycle_status = 'ACTIVE'"), CYCLE, custom={"long": (long, 0.35)}).select("thought_id", F.round("score", 6).alias("score"))


_GATES = "(j IS NULL OR coalesce(json_extract_string(j, '$.content_type'), '') != 'code') AND 100 - created_cycle >= 1 AND score > {over} AND priority != 'P1' AND thought_type IN ('OBSERVATION')"


@query("m5_promote", _M3 + f", sj AS (SELECT *, {_JSON} AS j FROM sc) SELECT thought_id, round(score, 6) AS score FROM sj WHERE {_GATES.format(over=0.4)} ORDER BY updated_cycle DESC, thought_id LIMIT (SELECT least(20, greatest(0, greatest(1, (count(*) * 0.3)::INT) - count(*) FILTER (priority = 'P1'))) FROM thought)", "thought")
def _(g: Graph) -> DataFrame:
    return C.promote(_scored(g), CYCLE, C.p1_slots(g.thought, 0.3), threshold=0.4).withColumn("score", F.round("score", 6))


@query("m4_confirmations", _M3 + f", sj AS (SELECT *, {_JSON} AS j FROM sc) SELECT thought_id, round(score, 6) AS score FROM sj WHERE {_GATES.format(over=0.3)} AND confirmation_count >= 2 AND 100 - created_cycle >= 70 ORDER BY updated_cycle DESC, thought_id LIMIT 15", "thought")
def _(g: Graph) -> DataFrame:
    return C.promote(_scored(g), CYCLE, 1000, threshold=0.3, allow_zero=False, min_age=70, most=15).withColumn("score", F.round("score", 6))


_KEEP = f", pool AS (SELECT * FROM thought WHERE (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') AND lifecycle_status IN ('ACTIVE', 'CREATED')), ks AS (SELECT *, 0.30 * {_SIGNALS['recency']} + 0.25 * {_SIGNALS['frequency']} + 0.20 * {_SIGNALS['confirmation']} + 0.15 * {_SIGNALS['confidence']} + 0.10 * {_SIGNALS['staleness']} AS keep_score FROM pool)"


@query("n3_keep_score", _KEEP + " SELECT thought_id, round(keep_score, 6) AS keep_score FROM ks", "thought")
def _(g: Graph) -> DataFrame:
    return H.keep_scores(g.thought, CYCLE, _NOW).select("thought_id", F.round("keep_score", 6).alias("keep_score"))


_OPEN = f"NOT pinned AND priority != 'P1' AND epoch(TIMESTAMP '{NOW}') - epoch(coalesce(last_accessed_at, updated_at, created_at)) >= 604800"


@query("n5_archive", _KEEP + f" SELECT thought_id, round(keep_score, 6) AS eviction_score FROM ks WHERE {_OPEN} AND keep_score < 0.45 ORDER BY keep_score, created_at NULLS FIRST, thought_id LIMIT 100", "thought")
def _(g: Graph) -> DataFrame:
    return H.to_archive(H.keep_scores(g.thought, CYCLE, _NOW), _NOW, threshold=0.45).withColumn("eviction_score", F.round("eviction_score", 6))


@query("n5_decay", _KEEP + f" SELECT thought_id, round(keep_score * 0.5, 6) AS eviction_score FROM ks WHERE {_OPEN} AND keep_score * 0.5 < 0.2 ORDER BY keep_score * 0.5, created_at NULLS FIRST, thought_id LIMIT 100", "thought")
def _(g: Graph) -> DataFrame:
    return H.to_archive(H.keep_scores(g.thought, CYCLE, _NOW), _NOW, decay=F.lit(0.5)).withColumn("eviction_score", F.round("eviction_score", 6))


@query("n8_archived", _KEEP + f""", ar AS (SELECT thought_id FROM ks WHERE {_OPEN} AND keep_score < 0.45 ORDER BY keep_score, created_at NULLS FIRST, thought_id LIMIT 100)
SELECT thought_id, CASE WHEN hit THEN 'ARCHIVED' ELSE lifecycle_status END AS lifecycle_status, CASE WHEN hit THEN 100 ELSE archived_at_cycle END AS archived_at_cycle, CASE WHEN NOT hit THEN expires_at END AS expires_at, revision + hit::INT AS revision FROM (SELECT *, thought_id IN (FROM ar) AS hit FROM thought)""", "thought")
def _(g: Graph) -> DataFrame:
    chosen = H.to_archive(H.keep_scores(g.thought, CYCLE, _NOW), _NOW, threshold=0.45)
    return H.archived(g.thought, chosen, CYCLE, _NOW).select("thought_id", "lifecycle_status", "archived_at_cycle", "expires_at", "revision")


@query("n10_dry_run", _KEEP + f""", ta AS (SELECT *, CASE WHEN pinned THEN 'pinned' WHEN priority = 'P1' THEN 'priority' WHEN NOT coalesce({_OPEN}, false) THEN 'recent' WHEN keep_score >= 0.45 THEN 'kept' END AS why FROM ks),
ra AS (SELECT *, row_number() OVER (PARTITION BY why IS NULL ORDER BY keep_score, created_at NULLS FIRST, thought_id) AS k FROM ta) SELECT thought_id, round(keep_score, 6) AS eviction_score, coalesce(why, CASE WHEN k <= 20 THEN 'archive' ELSE 'cap' END) AS outcome FROM ra""", "thought")
def _(g: Graph) -> DataFrame:
    return H.reviewed(H.keep_scores(g.thought, CYCLE, _NOW), _NOW, threshold=0.45, cap=20).withColumn("eviction_score", F.round("eviction_score", 6))


@query("n9_gc", f"SELECT thought_id FROM thought WHERE lifecycle_status = 'ARCHIVED' AND NOT pinned AND priority != 'P1' AND 100 - archived_at_cycle >= 10 AND epoch(TIMESTAMP '{NOW}') - epoch(archived_at) >= 2592000", "thought")
def _(g: Graph) -> DataFrame:
    return H.to_collect(g.thought, CYCLE, _NOW)


@query("i3_event_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    return g.base("events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("c9_point_in_time_edges", "SELECT e.edge_id FROM edge e JOIN thought a ON a.thought_id = e.from_thought_id JOIN thought b ON b.thought_id = e.to_thought_id WHERE " + " AND ".join(f"({x}.valid_from IS NULL OR {x}.valid_from <= TIMESTAMP '2024-01-20 00:00:00') AND ({x}.valid_until IS NULL OR {x}.valid_until > TIMESTAMP '2024-01-20 00:00:00')" for x in "eab"), "thought", "edge")
def _(g: Graph) -> DataFrame:
    at = valid_at(datetime(2024, 1, 20))
    rows = g.thought.filter(at).select("thought_id")
    return g.edge.filter(at).join(rows.withColumnRenamed("thought_id", "from_thought_id"), "from_thought_id", "left_semi").join(rows.withColumnRenamed("thought_id", "to_thought_id"), "to_thought_id", "left_semi").select("edge_id")


def _edges(name: str, direction: str, sql: str) -> None:
    @query(name, f"SELECT edge_id, weight FROM edge WHERE {sql} ORDER BY weight DESC, edge_id LIMIT 5", "edge")
    def _(g: Graph) -> DataFrame:
        return L.get_edges(g.edge, "d000000033", direction, 5).select("edge_id", "weight")


_edges("a5_edges_both", "BOTH", "from_thought_id = 'd000000033' OR to_thought_id = 'd000000033'")
_edges("a5_edges_in", "IN", "to_thought_id = 'd000000033'")
_edges("a5_edges_out", "OUT", "from_thought_id = 'd000000033'")


@query("a3_list_thoughts", f"SELECT thought_id FROM thought WHERE priority = 'P2' AND visibility != 'private' AND updated_cycle BETWEEN 10 AND 60 AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') ORDER BY updated_cycle DESC, thought_id LIMIT 50", "thought")
def _(g: Graph) -> DataFrame:
    return L.list_thoughts(g.thought, _NOW, priority="P2", exclude_visibility="private", min_cycle=10, max_cycle=60).select("thought_id")


@query("a3_list_provenance", "SELECT thought_id FROM thought WHERE json_extract_string(provenance, '$.run.id') = 'r2' AND visibility = 'public' ORDER BY updated_cycle DESC, thought_id LIMIT 20 OFFSET 10", "thought")
def _(g: Graph) -> DataFrame:
    return L.list_thoughts(g.thought, _NOW, visibility="public", include_expired=True, provenance=matches("provenance", [("$.run.id", "r2")]), limit=20, offset=10).select("thought_id")


@query("b3_relational_join", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' GROUP BY n_name")
def _(g: Graph) -> DataFrame:
    o, c, n = (g.base(t) for t in ("orders", "customer", "nation"))
    return o.filter("o_orderstatus = 'O'").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("h1_set_operations", "(SELECT thought_id FROM thought WHERE priority = 'P1' INTERSECT SELECT to_thought_id FROM edge) EXCEPT SELECT owner_id FROM embedding", "thought", "edge", "embedding")
def _(g: Graph) -> DataFrame:
    found = g.thought.filter("priority = 'P1'").select("thought_id").intersect(g.edge.select(F.col("to_thought_id").alias("thought_id")))
    return found.exceptAll(g.embedding.select(F.col("owner_id").alias("thought_id")))


@query("e9_rolling_latency", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def _(g: Graph) -> DataFrame:
    w = W.partitionBy("event_type").orderBy("event_id").rowsBetween(-9, 0)
    return g.base("events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@query("d21_scores_by_type", "SELECT role, count(*) AS turns, round(avg(CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM conversations GROUP BY ROLLUP (role)")
def _(g: Graph) -> DataFrame:
    return g.base("conversations").rollup("role").agg(F.count("*").alias("turns"), F.round(F.avg(F.contains(F.lower("text"), F.lit("the")).cast("double")), 6).alias("hit_rate"))


@query("a2_get", "SELECT thought_id, priority, 'seen' AS mark FROM thought WHERE thought_id = 'd000000042'", "thought")
def _(g: Graph) -> DataFrame:
    return L.get_thought(g.thought, "d000000042", on_retrieve=lambda df: df.withColumn("mark", F.lit("seen"))).select("thought_id", "priority", "mark")


@query("a4_count_unexpired", f"SELECT count(*) AS \"count\" FROM thought WHERE thought_type = 'NOTE' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')", "thought")
def _(g: Graph) -> DataFrame:
    return L.count_thoughts(g.thought, _NOW, thought_type="NOTE")


@query("a6_list_edges", "SELECT edge_id, created_cycle FROM edge WHERE edge_type = 'ASSOCIATED' AND source = 'EXPERIENCE' ORDER BY created_cycle DESC, edge_id LIMIT 200", "edge")
def _(g: Graph) -> DataFrame:
    return L.list_edges(g.edge, "ASSOCIATED", "EXPERIENCE", limit=200).select("edge_id", "created_cycle")


@query("a7_embedding_and_actions", "SELECT a.action_id, a.status, v.dimension::INT AS dimension FROM action a LEFT JOIN embedding v ON v.owner_id = a.source_thought_id WHERE a.source_thought_id = 'd000000014'", "action", "embedding")
def _(g: Graph) -> DataFrame:
    one = L.get_embedding(g.embedding, "d000000014").select(F.col("owner_id").alias("source_thought_id"), F.col("dimension").cast("int").alias("dimension"))
    return L.get_actions(g.action, "d000000014").join(one, "source_thought_id", "left").select("action_id", "status", "dimension")


@query("a8_snapshot_round_trip", "SELECT thought_id, essence, created_cycle, confidence, created_at, valid_until, pinned::BIGINT AS pinned, metadata_json FROM thought", "thought")
def _(g: Graph) -> DataFrame:
    text = snapshot.lines({"thought": g.thought, "edge": g.edge})
    return snapshot.parsed(text, "thought")[0].select("thought_id", "essence", "created_cycle", "confidence", "created_at", "valid_until", "pinned", "metadata_json")


@query("c11_restore_conflicts", "SELECT edge_id FROM edge WHERE created_cycle BETWEEN 20 AND 30", "edge")
def _(g: Graph) -> DataFrame:
    return snapshot.merged(g.edge.filter("created_cycle <= 30"), g.edge.filter("created_cycle >= 20"), "edge_id")[1]


@query("a9_restore", "SELECT edge_id, edge_type FROM edge WHERE created_cycle < 20 OR created_cycle > 30 OR created_cycle BETWEEN 20 AND 30", "edge")
def _(g: Graph) -> DataFrame:
    return snapshot.merged(g.edge.filter("created_cycle <= 30"), g.edge.filter("created_cycle >= 20"), "edge_id")[0].select("edge_id", "edge_type")


@query("a13_bag_of_words", r""", w AS (SELECT thought_id, unnest(list_filter(regexp_split_to_array(lower(essence), '[^\p{L}\p{N}]+'), lambda x: x != '')) AS x FROM thought), c AS (SELECT thought_id, (('0x' || substr(sha1(x), 1, 8))::BIGINT % 256)::INT AS pos, count(*) AS n FROM w GROUP BY 1, 2)
SELECT thought_id, pos, round((n / sqrt(sum(n * n) OVER (PARTITION BY thought_id)))::DOUBLE, 5) AS value FROM c""", "thought")
def _(g: Graph) -> DataFrame:
    at = g.thought.select("thought_id", F.posexplode(bag_of_words(F.col("essence"))).alias("pos", "value"))
    return at.filter("value > 0").select("thought_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value"))


@query("a17_turns", "SELECT concat('c', conv_id) AS session_id, turn::INT AS turn, role, text AS content FROM conversations")
def _(g: Graph) -> DataFrame:
    """Turns as nested questions and back, as their loader reads them."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    session = g.base("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    nested = session.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"), F.transform("t", lambda x: x["turn"]).alias("places"))
    question = nested.select(F.col("session_id").alias("question_id"), F.array(F.struct("session_id", "turns")).alias("haystack_sessions"), F.array("session_id").alias("answer_session_ids"), "places")
    told = conversations.turns(question).join(question.select("question_id", "places"), "question_id")
    return told.select("session_id", F.get("places", F.col("turn")).cast("int").alias("turn"), "role", "content")


@query("d19_embedding_identities", "SELECT DISTINCT model_name, dimension::INT AS dimension FROM embedding", "embedding")
def _(g: Graph) -> DataFrame:
    return g.embedding.select("model_name", F.col("dimension").cast("int").alias("dimension")).distinct()


@query("f23_transitions", """, s AS (SELECT unnest(['CREATED', 'ACTIVE', 'DONE', 'ARCHIVED']) AS new) SELECT lifecycle_status, new, count(*) AS n, (lifecycle_status = 'CREATED' AND new = 'ACTIVE') OR (lifecycle_status = 'ACTIVE' AND new IN ('DONE', 'ARCHIVED')) OR (lifecycle_status = 'DONE' AND new = 'ARCHIVED') OR (lifecycle_status = 'ARCHIVED' AND new = 'ACTIVE') AS may FROM thought, s GROUP BY ALL""", "thought")
def _(g: Graph) -> DataFrame:
    states = F.explode(F.array(*map(F.lit, S.LIFECYCLE)))
    rows = g.thought.groupBy("lifecycle_status").agg(F.count("*").alias("n")).withColumn("new", states)
    return rows.select("lifecycle_status", "new", "n", S.may_follow(S.LIFECYCLE, F.col("lifecycle_status"), F.col("new")).alias("may"))


@query("f25_metadata", """SELECT doc_id, '{"perspective":"percept","source":{"is_self":false,"confidence":"medium","id":"x"},"lang":"de","content_type":"natural_language"}' AS metadata FROM documents""")
def _(g: Graph) -> DataFrame:
    return g.base("documents").select("doc_id", conversations.metadata("percept", source_id="x", confidence="medium", lang="de").alias("metadata"))


@query("f26_max_cosine", ", s AS (SELECT x.owner_id, max(list_cosine_similarity(x.vector::DOUBLE[], y.vector::DOUBLE[])) AS best FROM embedding x JOIN embedding y ON y.owner_id IN ('d000000003', 'd000000004', 'd000000005') GROUP BY 1) SELECT owner_id, best >= 0.3 AS hit FROM s", "embedding")
def _(g: Graph) -> DataFrame:
    answers = [r[0] for r in g.embedding.filter(F.col("owner_id").isin("d000000003", "d000000004", "d000000005")).select("vector").collect()]
    best = F.greatest(*[cosine(F.col("vector"), F.array(*map(F.lit, map(float, v)))) for v in answers])
    return g.embedding.select("owner_id", (best >= 0.3).alias("hit"))


_SPLIT = "SELECT thought_id AS source_id, unnest(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 1)) AS content FROM thought WHERE len(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 1)) BETWEEN 2 AND 32"


def _derived(g: Graph):
    return D.derive(g.thought, paragraphs(F.col("content")), g.thought, g.edge, on_error="log")


@query("j4_derived_records", f", p AS ({_SPLIT}) SELECT DISTINCT concat('c', substr(sha256(content), 1, 32)) AS thought_id, content FROM p", "thought")
def _(g: Graph) -> DataFrame:
    return _derived(g)[0].select("thought_id", "content")


@query("j4_derived_edges", f", p AS ({_SPLIT}) SELECT DISTINCT concat('c', substr(sha256(content), 1, 32)) AS from_thought_id, source_id AS to_thought_id FROM p", "thought")
def _(g: Graph) -> DataFrame:
    return _derived(g)[1].select("from_thought_id", "to_thought_id")


@query("j5_backfill", f""", p AS ({_SPLIT}), l AS (SELECT thought_id, len(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 1)) AS n FROM thought)
SELECT thought_id, cast(0 AS BIGINT) AS created, coalesce(count(source_id), 0) AS reused, any_value(CASE WHEN n > 32 THEN n ELSE 0 END) AS skipped FROM l LEFT JOIN p ON source_id = thought_id GROUP BY 1""", "thought")
def _(g: Graph) -> DataFrame:
    """Run again over records whose children are there: all are reused."""
    new = _derived(g)[0]
    return D.derive(g.thought, paragraphs(F.col("content")), g.thought.select("thought_id").unionByName(new.select("thought_id")), g.edge, on_error="log")[2]


@query("m18_counters", _M3 + """ SELECT count(*) AS candidates_evaluated, (count(*) FILTER (100 - created_cycle < 60)) AS skipped_gate_count, cast(0 AS BIGINT) AS promoted_count, (SELECT count(*) FROM edge WHERE edge_type = 'CONSOLIDATED_FROM') AS edges_created,
  (SELECT count(*) FROM thought WHERE thought_type = 'REFLECTION') AS reflections_created, cast(0 AS BIGINT) AS orphans_retired, round((SELECT count(*) FILTER (priority = 'P1') / count(*)::DOUBLE FROM thought), 6) AS p1_fraction_after FROM sc""", "thought", "edge")
def _(g: Graph) -> DataFrame:
    none, made = g.thought.limit(0), g.edge.filter("edge_type = 'CONSOLIDATED_FROM'")
    told = C.counters(_scored(g), none, made, g.thought.filter("thought_type = 'REFLECTION'"), none, g.thought, CYCLE, min_age=60)
    return told.withColumn("p1_fraction_after", F.round("p1_fraction_after", 6))
