"""The graph's operators on literal rows, with values worked out by hand or by a plain loop."""

import hashlib
import json
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.__main__ import run
from graphloom.functions.embedding import bag_of_words, provided
from graphloom.functions.segments import segments
from graphloom.functions.text import char_windows, entities, folded, key_tokens, tokens, truncated, word_windows
from graphloom.operators import consolidation as C
from graphloom.operators import derived as D
from graphloom.operators import hygiene as H
from graphloom.operators import reads
from graphloom.operators import retrieval as R
from graphloom.operators import store as S
from graphloom.operators.graphs import label_propagation
from graphloom.plans import fts
from graphloom.plans.mql import compiled, parse
from graphloom.sources import conversations, snapshot
from graphloom.sources.services import Services
from graphloom.streaming import access

NOW = datetime(2024, 2, 15)
THOUGHT = """thought_id string, thought_type string, essence string, content string, content_hash string, priority string, lifecycle_status string, created_cycle long, updated_cycle long, source string,
confidence double, source_type string, confirmation_count long, visibility string, access_count long, last_accessed_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, expires_at timestamp_ntz,
metadata_json string, valid_from timestamp_ntz, valid_until timestamp_ntz, action_outcome_score double, pinned boolean, archived_at_cycle long, archived_at timestamp_ntz, revision long"""
DEFAULT = {
    "thought_type": "OBSERVATION", "priority": "P3", "lifecycle_status": "ACTIVE", "created_cycle": 0, "updated_cycle": 0, "source": "s", "source_type": "EXPERIENCE", "confirmation_count": 0, "access_count": 0,
    "created_at": datetime(2024, 1, 1), "metadata_json": None, "pinned": False, "revision": 1,
}


def thoughts(spark, *rows):
    names = [x.split()[0] for x in THOUGHT.replace("\n", " ").split(",")]
    out = []
    for i, r in enumerate(rows):
        one = {"thought_id": f"t{i}", "content": f"text {i}", **DEFAULT, **r}
        one.setdefault("essence", one["content"][:200])
        one.setdefault("content_hash", hashlib.sha256(one["content"].encode()).hexdigest())
        out.append(tuple(one.get(n) for n in names))
    return spark.createDataFrame(out, THOUGHT)


def edges(spark, *rows):
    return spark.createDataFrame([(f"e{i}", *r) for i, r in enumerate(rows)], "edge_id string, from_thought_id string, to_thought_id string, edge_type string, weight double")


def vectors(spark, *rows):
    return spark.createDataFrame([(f"v{o}", o, "m", len(v), v) for o, v in rows], "embedding_id string, owner_id string, model_name string, dimension int, vector array<float>")


def ids(df, col="thought_id"):
    return sorted(r[col] for r in df.collect())


def test_keep_score_adds_the_raw_signals(spark):
    rows = thoughts(spark, {"created_cycle": 0, "updated_cycle": 50, "confidence": 0.8, "confirmation_count": 5, "access_count": 10})
    got = H.keep_scores(rows, 100, NOW).first()
    assert math.isclose(got.keep_score, 0.30 * math.exp(-0.5) + 0.25 * 1 + 0.20 * 1 + 0.15 * 0.8 + 0.10 * 0.5) and got.used


def test_signals_without_a_source_are_shared_out(spark):
    rows = thoughts(spark, {"updated_cycle": 50}, {"updated_cycle": 100})
    told = H.keep_scores(rows, 100, NOW).orderBy("thought_id").collect()
    assert math.isclose(told[0].keep_score, (0.30 * math.exp(-0.5) + 0.10 * 0.5) / 0.40) and not told[0].used
    assert H.to_archive(H.keep_scores(rows, 100, NOW), NOW, threshold=1.0).count() == 0
    # A confidence that is there counts even where it is 0, and half of one where it is missing.
    rows = thoughts(spark, {"confidence": 0.0}, {"confidence": None})
    w = C.promotion_weights(rows, 10)
    assert w["confirmation"] == w["frequency"] == w["action_outcome"] == 0 and math.isclose(w["confidence"], 0.15 / 0.60)
    assert C.promotion_weights(rows, None)["recency"] == 0
    told = thoughts(spark, {"access_count": 3, "action_outcome_score": 0.0})
    assert C.promotion_weights(told, 10, access_tracking=False)["frequency"] == 0 < C.promotion_weights(told, 10)["action_outcome"]


def test_a_dry_run_says_why(spark):
    old = {"last_accessed_at": datetime(2024, 1, 1), "confirmation_count": 0}
    rows = thoughts(
        spark, {**old, "pinned": True}, {**old, "priority": "P1"}, {"last_accessed_at": datetime(2024, 2, 14)}, {"created_at": None}, {**old, "access_count": 10, "updated_cycle": 100}, old, {**old, "created_at": datetime(2023, 1, 1)},
        {**old, "thought_type": "NOTE", "expires_at": datetime(2024, 1, 1)},
    )
    told = {r.thought_id: r.outcome for r in H.reviewed(H.keep_scores(rows, 100, NOW), NOW, threshold=0.3, cap=1).collect()}
    assert told == {"t0": "pinned", "t1": "priority", "t2": "recent", "t3": "recent", "t4": "kept", "t5": "cap", "t6": "archive"}
    chosen = H.to_archive(H.keep_scores(rows, 100, NOW), NOW, threshold=0.3, cap=1)
    got = {r.thought_id: r for r in H.archived(rows, chosen, 100, NOW).collect()}
    assert (got["t6"].lifecycle_status, got["t6"].archived_at_cycle, got["t6"].archived_at, got["t6"].expires_at, got["t6"].revision) == ("ARCHIVED", 100, NOW, None, 2) and got["t5"].revision == 1
    for decay, n in ((float("nan"), 2), (5.0, 2), (-1.0, 3), (float("inf"), 2)):
        assert H.to_archive(H.keep_scores(rows, 100, NOW), NOW, threshold=0.3, decay=F.lit(decay)).count() == n


def test_promotion_takes_the_first_that_pass(spark):
    good = {"created_cycle": 0, "confirmation_count": 5, "confidence": 1.0, "access_count": 10, "action_outcome_score": 1.0}
    rows = thoughts(
        spark, {**good, "updated_cycle": 100}, {**good, "updated_cycle": 99}, {**good, "updated_cycle": 98, "priority": "P1"}, {**good, "updated_cycle": 97, "thought_type": "NOTE"}, {**good, "updated_cycle": 96, "created_cycle": 100},
        {**good, "updated_cycle": 95, "metadata_json": '{"content_type": "code"}'}, {**good, "updated_cycle": 94}, {"updated_cycle": 93},
    )
    scored = C.promotion_scores(rows, 100)
    assert math.isclose(scored.filter("thought_id = 't0'").first().score, 1.0)
    assert ids(C.promote(scored, 100, 10)) == ["t0", "t1", "t6"] and ids(C.promote(scored, 100, 2)) == ["t0", "t1"]
    assert C.p1_slots(rows, 0.05) == 0 and C.p1_slots(rows, 0.5) == 3 and C.p1_slots(rows.limit(0)) == 1
    assert C.should_cluster(rows, None) == (True, 7) and C.should_cluster(rows, 5) == (False, 5) and C.should_cluster(rows, 5, min_new=2) == (True, 7)


@pytest.mark.parametrize(
    ("how", "want"),
    [({}, "abcdefgh"), ({"self_mode": "external_only"}, "abcegh"), ({"self_mode": "self_only"}, "abcdfgh"), ({"min_confidence": "medium"}, "abdeh"), ({"perspectives": ["thought"]}, "abcdegh"), ({"types": ["natural_language"]}, "abcdefg")],
)
def test_eligibility(spark, how, want):
    docs = {
        "a": None, "b": "{}", "c": '{"x": 1}', "d": '{"source": {"is_self": true, "confidence": "high"}}', "e": '{"source": {"is_self": false, "confidence": "medium"}}',
        "f": '{"perspective": "percept", "source": {"is_self": true, "confidence": 3}}', "g": '{"source": {"is_self": "true"}}', "h": '{"source": {"confidence": "high"}, "content_type": "table"}', "i": '{"content_type": "code"}',
    }
    df = spark.createDataFrame(list(docs.items()), "k string, metadata_json string")
    assert "".join(sorted(r.k for r in df.filter(C.eligible(**how)).collect())) == want


def judge(spark, contents, cohesion=1.0, phrases=None):
    rows = thoughts(spark, *[{"content": c} for c in contents])
    member = rows.select("thought_id", F.lit("c").alias("cluster_id"))
    cohesive = spark.createDataFrame([("c", cohesion)], "cluster_id string, cohesion double")
    if phrases is not None:
        phrases = spark.createDataFrame([("c", p) for p in phrases], "cluster_id string, phrase string")
    return C.gates(member, rows, cohesive, phrases).first().rejected_by


def test_gates_in_order(spark):
    assert judge(spark, ["x", "x", "y"]) == "duplicate"
    assert judge(spark, ["She is a nurse", "Born in 1950", "He is the head", "other"]) == "persona"
    assert judge(spark, ["[USER] she is a nurse", "[USER] born in 1950", "he is the head", "other"]) is None
    assert judge(spark, ["I can't", "we can", "x"]) == "contradiction"
    # A word that only ends like one of the opposites is none.
    assert judge(spark, ["I can't", "un écan", "scan, can't"]) is None
    assert judge(spark, ["a", "b", "c"], cohesion=0.39) == "cohesion" and judge(spark, ["a", "b", "c"], cohesion=0.4) is None
    assert judge(spark, ["about Alice", "Alice again", "Bob only", "Carol too"]) == "entities"
    assert judge(spark, ["about Alice", "Alice again", "Alice here", "Carol too"]) is None
    assert judge(spark, ["no names", "Alice again", "Bob here"]) is None
    assert judge(spark, ["a", "b"], phrases=["these moments", "Some things"]) == "generic" and judge(spark, ["a", "b"], phrases=[]) == "generic"
    assert judge(spark, ["a", "b"], phrases=["these moments", "river bank"]) is None and judge(spark, ["a", "b"], phrases=["these"]) is None


def test_keywords_and_phrases(spark):
    rows = thoughts(spark, {"content": "[USER] User: zebra apple zebra mango"}, {"content": "apple mango kiwi"}, {"content": "The kiwi and the fig"}).withColumn("cluster_id", F.lit("c"))
    assert [(r.word, r.n) for r in C.keywords(rows, 4).orderBy(F.col("n").desc()).collect()][:1] == [("zebra", 2)] and {r.word for r in C.keywords(rows, 4).collect()} == {"zebra", "apple", "mango", "kiwi"}
    assert {r.word for r in C.keywords(rows, 2).collect()} == {"zebra", "apple"}
    got = {r.phrase: r.score for r in C.tfidf(rows.limit(2), rows, 50).collect()}
    assert got["apple mango"] == round(1 * math.log(4 / 2), 4) and got["zebra apple zebra"] == round(math.log(4 / 2), 4) and "user zebra" not in got and len(got) == 8
    everywhere = thoughts(spark, *[{"content": "red fox runs"}] * 3).withColumn("cluster_id", F.lit("c"))
    assert {r.score for r in C.tfidf(everywhere, everywhere).collect()} == {0.0}
    found = spark.createDataFrame([(c, p, 1.0) for c, p in [("a", "x y"), ("a", "own a"), ("b", "X y"), ("b", "own b"), ("c", "x y"), ("d", "d"), ("e", "e")]], "cluster_id string, phrase string, score double")
    assert {r.phrase: r.clusters for r in C.phrase_frequency(found).collect()}["x y"] == 3
    assert sorted(r.phrase for r in C.without_boilerplate(found, 5).collect()) == ["d", "e", "own a", "own b", "x y"]
    assert C.without_boilerplate(found, 4).count() == 7


def test_reflections(spark):
    rows = thoughts(spark, {"content": "Alice likes rivers", "created_at": None}, {"content": "rivers by Alice", "priority": "P2"}, {"content": "Alice, rivers, 1974", "valid_from": datetime(2024, 1, 1)})
    member = rows.select("thought_id", F.lit("c").alias("cluster_id"))
    own = member.join(rows, "thought_id")
    summary = C.summaries(member, rows, excerpts=2)
    made = C.reflections(summary, C.keywords(own, 10), C.tfidf(own, rows), rows, 7, NOW)
    r = made.first()
    told = json.loads(r.content)
    digest = hashlib.sha256(json.dumps(["t0", "t1", "t2"]).encode()).hexdigest()[:16]
    assert told["cluster_hash"] == digest and r.source == f"dreaming:{digest}" and told["member_ids"] == ["t0", "t1", "t2"] and told["version"] == 2
    assert told["named_entities"] == ["1974", "Alice"] and [x["thought_id"] for x in told["member_excerpts"]] == ["t1", "t0"] and r.essence.startswith("REFLECTION [alice, rivers")
    assert r.valid_from is None and told["temporal_span"]["min_created_at"] == "2024-01-01T00:00:00+00:00"
    again = rows.unionByName(made.select("thought_id", "thought_type", "source"), allowMissingColumns=True)
    assert C.reflections(summary, C.keywords(own, 10), C.tfidf(own, rows), again, 8, NOW).count() == 0
    assert [(x.to_thought_id, x.weight) for x in C.lineage(made, 7).orderBy("to_thought_id").collect()] == [("t0", 1.0), ("t1", 1.0), ("t2", 1.0)]


def test_labels_spread_inside_groups(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0")]
    got = {r.thought_id: r.cluster_id for r in label_propagation(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert len(got) == 12 and len({v for k, v in got.items() if k[0] == "a"}) == 1 == len({v for k, v in got.items() if k[0] == "b"})
    assert len(set(got.values())) == 2


def test_expansion_brings_no_ineligible_source_back(spark):
    rows = thoughts(spark, {"thought_type": "REFLECTION"}, {}, {"lifecycle_status": "ARCHIVED"}, {"thought_type": "NOTE"}, {})
    e = edges(spark, ("t0", "t1", "CONSOLIDATED_FROM", 0.5), ("t0", "t2", "CONSOLIDATED_FROM", 1.0), ("t0", "t3", "CONSOLIDATED_FROM", 1.0), ("t0", "t4", "ASSOCIATED", 1.0))
    found = spark.createDataFrame([("t0", 1.0), ("t1", 0.2)], "thought_id string, score double")
    got = {r.thought_id: round(r.score, 6) for r in R.expand(found, rows, e, eligible=F.col("lifecycle_status") == "ACTIVE").collect()}
    assert got == {"t0": 1.0, "t1": 0.35}
    assert set(r.thought_id for r in R.expand(found, rows, e, ceiling=2).collect()) == {"t0", "t1"}


def searched(spark, **how):
    rows = thoughts(spark, {"content": "green tea", "updated_cycle": 100, "metadata_json": '{"u": 1}'}, {"content": "black coffee", "updated_cycle": 50, "metadata_json": '{"u": 1}'}, {"content": "tea leaves in a summary", "thought_type": "REFLECTION", "updated_cycle": 60})
    e = edges(spark, ("t2", "t1", "CONSOLIDATED_FROM", 1.0))
    v = vectors(spark, ("t0", [0.4, math.sqrt(1 - 0.16)]), ("t1", [0.0, 1.0]), ("t2", [0.1, 0.9]))
    return R.search(rows, v, e, now=NOW, **how)


def test_search_by_hand(spark):
    found = searched(spark, query="green", vector=[1.0, 0.0], cycle=100, weights={"fts": 0.2, "vector": 0.3, "recency": 0.5, "priority": 0.0}, include_reflections=False)
    best = found.rows.first()
    assert (best.rank, best.thought_id) == (1, "t0") and math.isclose(best.score, 0.5 * 0.2 + 0.4 * 0.3 + 1.0 * 0.5, abs_tol=1e-6)
    assert {"fts", "vector", "recency"} <= found.backends_used and "t2" not in ids(found.rows)
    found = searched(spark, query="tea", cycle=100, collapse_key="$.u", reflection_boost=10.0, top_k=2, reflection_cap=0.5)
    assert [r.thought_id for r in found.rows.orderBy("rank").collect()] == ["t2", "t0"] or ids(found.rows) == ["t1", "t2"]
    assert searched(spark, query="tea", cycle=100, reflection_cap=0.0).reflections_evicted == 1
    assert ids(searched(spark, top_k=2).rows) == ["t0", "t2"] and {r.score for r in searched(spark, weights={"priority": 0.0}).rows.collect()} == {0.0}
    assert ids(searched(spark, query="nothing like it").rows) == []


@pytest.mark.parametrize("how", [{"cycle": 1, "recency_now": NOW}, {"cycle": 1, "half_life": 0.0}, {"collapse_key": "$.u", "collapse_max": 0}, {"collapse_key": "u", "query": "tea"}])
def test_search_says_what_is_wrong(spark, how):
    with pytest.raises(ValueError):
        searched(spark, **how).rows.collect()


def test_vectors_that_find_nothing(spark):
    rows, v = thoughts(spark, {}), vectors(spark, ("t0", [1.0, 0.0]))
    for bad in ([], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 0.0]):
        assert R.knn(v, rows, bad).count() == 0
    with pytest.raises(ValueError):
        R.search_similar(v, rows, [0.0, 0.0, 0.0], dimension=2)
    assert ids(R.search_similar(v, rows, [1.0, 1.0], dimension=2)) == ["t0"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("essence:memory", "essence:memory"), ('content:"machine learning"', 'content:"machine learning"'), ("cats NOT dogs", "cats NOT dogs"), ('("machine learning") AND cats', '("machine learning") AND cats'),
        ("content:memory AND REQ-FUNC*", 'content:memory AND "REQ-FUNC"*'), ("REQ-FUNC AND well-known", '"REQ-FUNC" AND "well-known"'), ("essence:body AND req-func", 'essence:body AND "req-func"'),
        ('"machine learning" AND req-func', '"machine learning" AND "req-func"'), ("coffee creamer coupon", "coffee OR creamer OR coupon"), ("sister's", "sister OR s"), ("http://example.com", "http OR example OR com"),
        ("?", ""), ("field*NOT", '"field*NOT"'), ("REQ-FUNC*", '"REQ-FUNC"*'), ("$5 coupon?", "5 OR coupon"), ("12:30", "12 OR 30"),
    ],
)
def test_normalized_text(text, want):
    assert fts.normalized(text) == want


def test_expert_texts():
    for text, want in (('"x"?', True), ('("Update Attributes")', True), ("l'école", False), ("REQ-FUNC*", False), ('he said "just one quote', False), ("cats AND dogs", True), ("content:memory", True), ("http://a", False)):
        assert fts.is_expert(text) is want, text
    for text, malformed in (("a AND b OR c", False), ("NOT", True), ("rely AND", True), ("(a OR b", True), ('"a" and "b".', True), ("tell me NOT", True), ("", False)):
        assert fts.parse(text)[1] is malformed, text
    assert fts.parse("a AND b OR c NOT d")[0] == fts.Logic("OR", (fts.Logic("AND", (fts.Phrase(("a",)), fts.Phrase(("b",)))), fts.Logic("NOT", (fts.Phrase(("c",)), fts.Phrase(("d",))))))


def test_keyword_search(spark):
    rows = thoughts(spark, {"content": "Café in the machine room", "essence": "x"}, {"content": "machine learning helps", "essence": "learning"}, {"content": "learning machine-made cafe", "essence": "y"}, {"content": "mach schnell", "essence": "z"})
    for text, want in (
        ("cafe", "02"), ("CAFÉ", "02"), ('"machine learning"', "1"), ("machin*", "012"), ("machine AND learning", "1"), ("learning NOT helps", "2"), ("essence:learning", "1"), ("content:learning", "12"),
        ("machine-made", "2"), ('"learning machine"', ""), ("(cafe OR schnell) AND m*", "023"), ("room learning", "012"), ("", ""),
    ):
        assert "".join(x[1] for x in ids(R.search_text(rows, text))) == want, text
    # The score of a word in both columns, and of a rarer one: a closed form.
    n, lengths = 4, [6, 4, 4, 3]
    idf = math.log((n - 2 + 0.5) / (2 + 0.5))
    got = {r.thought_id: r.score for r in R.bm25(rows, ["learning"]).collect()}
    idf = idf if idf > 0 else 1e-6
    assert math.isclose(got["t1"], idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * lengths[1] / (sum(lengths) / n))))


def test_store(spark):
    rows = thoughts(spark, {"content": "a", "confirmation_count": 1}, {"content": "b"})
    new = thoughts(spark, {"thought_id": "n1", "content": "c"}, {"thought_id": "n2", "content": "c"}, {"thought_id": "n3", "content": "a"}, {"thought_id": "t1", "content": "d"})
    assert {r.thought_id for r in S.get_or_create(rows, new).filter("created").collect()} == {"n1", "t1"}
    out, conflict = S.create(rows, new, NOW, deduplicate=True, ttl_s=60)
    got = {r.thought_id: r for r in out.collect()}
    assert set(got) == {"t0", "t1", "n1"} and got["t0"].confirmation_count == 2 and got["n1"].confirmation_count == 1 and got["n1"].expires_at == datetime(2024, 2, 15, 0, 1) and ids(conflict) == ["t1"]
    seen = S.create(rows, new, NOW, deduplicate=True, on_store=lambda df: df.withColumn("source", F.lit("hook")))[0]
    assert ids(seen.filter("source = 'hook'")) == ["n1"]
    with pytest.raises(ValueError):
        S.bulk_store(rows, new, NOW)
    assert S.bulk_store(rows, new.filter("thought_id LIKE 'n%'"), NOW).count() == 5
    changed = {r.thought_id: r for r in S.upsert(rows, new.filter("thought_id LIKE 'n%'").withColumn("priority", F.lit("P1"))).collect()}
    assert changed["t0"].priority == "P1" and changed["t0"].confirmation_count == 1 and changed["t0"].revision == 1 and changed["t1"].priority == "P3" and set(changed) == {"t0", "t1", "n2"}
    told = S.remembered(spark.createDataFrame([("r", "x" * 300)], "thought_id string, text string")).first()
    assert (told.thought_type, told.priority, told.lifecycle_status, told.created_cycle, len(told.essence)) == ("NOTE", "P3", "ACTIVE", 0, 200)
    back, bad = S.restore(thoughts(spark, {"lifecycle_status": "ARCHIVED", "archived_at_cycle": 3}, {}), spark.createDataFrame([("t0",), ("t1",), ("zz",)], "thought_id string"), 9)
    one = back.filter("thought_id = 't0'").first()
    assert (one.lifecycle_status, one.archived_at_cycle, one.updated_cycle, one.revision) == ("ACTIVE", None, 9, 2) and ids(bad) == ["t1", "zz"]


def test_edges_vectors_actions(spark):
    rows = thoughts(spark, {}, {}, {})
    e = edges(spark, ("t0", "t1", "ASSOCIATED", 0.5))
    new = spark.createDataFrame([("n0", "t1", "t0", "ASSOCIATED", 0.5), ("n1", "t0", "t1", "ASSOCIATED", 0.5), ("n2", "t0", "zz", "ASSOCIATED", 0.5), ("n3", "t0", "t2", "BRIDGE", 1.5), ("n4", "t1", "t0", "ASSOCIATED", 0.1)], e.schema)
    out, bad = S.create_edges(e, new, rows)
    assert ids(out, "edge_id") == ["e0", "n0"] and {r.edge_id: r.reason for r in bad.collect()} == {"n1": "duplicate", "n2": "endpoint", "n3": "weight", "n4": "duplicate"}
    v = vectors(spark, ("t0", [1.0, 0.0]))
    assert sorted((r.owner_id, r.vector[0]) for r in S.store_embeddings(v, vectors(spark, ("t0", [0.5, 0.5]), ("t1", [0.0, 1.0]))).collect()) == [("t0", 0.5), ("t1", 0.0)]
    for bad_vector in (vectors(spark, ("t1", [1.0, 0.0, 0.0])), vectors(spark, ("t1", [1.0, 0.0])).withColumn("model_name", F.lit("other")), vectors(spark, ("t1", [1.0])).withColumn("dimension", F.lit(2))):
        with pytest.raises(ValueError):
            S.store_embeddings(v, bad_vector)
    schema = "action_id string, source_thought_id string, status string, verification_status string"
    actions = spark.createDataFrame([("a", "t0", "PLANNED", "PENDING"), ("b", "t0", "EXECUTING", "PENDING"), ("c", "t1", "CONFIRMED", "PENDING")], schema)
    out, bad = S.update_actions(actions, spark.createDataFrame([("a", "CONFIRMED", None), ("b", "CONFIRMED", "CONFIRMED"), ("c", None, "FAILED"), ("z", "PLANNED", None)], "action_id string, status string, verification_status string"))
    assert {r.action_id: (r.status, r.verification_status) for r in out.collect()} == {"a": ("PLANNED", "PENDING"), "b": ("CONFIRMED", "CONFIRMED"), "c": ("CONFIRMED", "FAILED")} and ids(bad, "action_id") == ["a", "z"]
    assert {r.source_thought_id: r.score for r in S.outcomes(out).collect()} == {"t0": 1.0, "t1": 0.0} and S.outcomes(actions.limit(1)).first().score is None
    assert {(r.table, r.id) for r in S.dangling(rows.limit(1), e, actions, v).collect()} == {("edge", "e0"), ("action", "c")}


def test_journal_binds_what_the_hash_covers(spark):
    schema = "svc string, sequence_number long, mutation_type string, target_id string, delta string"
    rows = [(s, i, "ADD", f"t{i}" if i % 2 else None, '{"b": 1, "a": {"z": 1,"y": "é"}}' if i % 3 else "{}") for s in ("x", "y", None) for i in range(1, 40)]
    entries = spark.createDataFrame(rows, schema).repartition(4)
    chain = {(r.service, r.sequence_number): r for r in S.append_journal(entries, "svc").collect()}
    for s in ("x", "y", ""):
        last = None
        for i in range(1, 40):
            delta = json.dumps({"a": {"y": "é", "z": 1}, "b": 1}) if i % 3 else "{}"
            own = hashlib.sha256(f"{i}|ADD|{f't{i}' if i % 2 else ''}|{delta}|{last or ''}".encode()).hexdigest()
            assert (chain[s, i].parent_hash, chain[s, i].entry_hash) == (last, own)
            last = own
    whole = entries.withColumn("service", F.coalesce("svc", F.lit(""))).join(S.append_journal(entries, "svc"), ["service", "sequence_number"])
    for block in (1, 7, 4096):
        assert {(r.service, r.first_broken, r.entries, r.valid) for r in S.verify_journal(whole, "service", block).collect()} == {("x", None, 39, True), ("y", None, 39, True), ("", None, 39, True)}
        n, s = F.col("sequence_number"), F.col("service")
        cut = whole.filter(~((s == "x") & (n == 8)) & ~((s == "y") & (n > 20))).withColumn("delta", F.when((s == "") & (n == 14), '{"a": 0}').otherwise(F.col("delta")))
        assert {(r.service, r.first_broken) for r in S.verify_journal(cut, "service", block).collect()} == {("x", 9), ("y", None), ("", 14)}
        # The order of keys and white space don't count.
        same = whole.withColumn("delta", F.when(F.col("delta") != "{}", '{"a":{"y":"\\u00e9","z":1},"b":1}').otherwise(F.col("delta")))
        assert S.verify_journal(same, "service", block).filter("valid").count() == 3


def test_expiry(spark):
    rows = thoughts(spark, {"expires_at": NOW}, {"expires_at": datetime(2025, 1, 1)}, {"expires_at": datetime(2024, 1, 1), "pinned": True}, {}, {"expires_at": NOW, "lifecycle_status": "ARCHIVED"})
    assert {r.thought_id: r.outcome for r in S.expire(rows, NOW).collect()} == {"t0": "archived", "t2": "kept"}
    gone = S.expire(rows, NOW, "delete", exclude="t0")
    assert {r.thought_id: r.outcome for r in gone.collect()} == {"t2": "kept", "t4": "deleted"} and tuple(S.expired_counts(gone).first()) == (1, 1)
    with pytest.raises(ValueError):
        S.expire(rows, NOW, "hide")


def test_text(spark):
    df = spark.createDataFrame([("In 1974 Ana paid US$20 for 5km, éAnn Bob2 The x10kg 12345 Été",)], "t string")
    assert df.select(entities(F.col("t"))).first()[0] == ["$20", "1974", "5km", "Ana", "Bob2"]
    one = lambda text, c: spark.createDataFrame([(text,)], "t string").select(c).first()[0]
    assert one("ÀÉÎ ß Ø ñandú", folded(F.col("t"))) == "aei ß ø nandu" and one("Foo-bar a_b, ÉTÉ!", tokens(F.col("t"))) == ["foo-bar", "a_b", "ete"]
    assert one("[assistant] Assistant: the big-cat naïve 123 ab [SYSTEM] gone\nkept", key_tokens(F.col("t"))) == ["big", "cat", "naïve", "123", "kept"]
    for text, want in (("short", "short"), ("one two three four", "one two..."), ("onetwothreefourfive", "onetwothree..."), ("onetwothree four five", "onetwothree..."), (" onetwothreefourfive", " onetwothre...")):
        assert one(text, truncated(F.col("t"), 14)) == want, text
    for n in range(1, 30):
        text = "".join(random.Random(n).choices("ab c", k=n))
        want, start = [], 0
        while start < n:
            want.append(text[start : start + 7])
            if start + 7 >= n:
                break
            start += 5
        assert one(text, char_windows(F.col("t"), 7, 5)) == (want if len(want) > 1 else [])
    text = " a  b c\td\n e f g  "
    assert one(text, word_windows(F.col("t"), 3, 2)) == ["a  b c", "c\td\n e", "e f g"] and one("a b c", word_windows(F.col("t"), 3, 2)) == []


def test_hashed_vectors(spark):
    texts = ["", "a", "Tea, tea & coffee!", "naïve été 12"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(bag_of_words(F.col("t"))).collect()]
    for text, vector in zip(texts, got, strict=True):
        want = [0.0] * 256
        for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
            want[int.from_bytes(hashlib.sha1(w.encode()).digest()[:4], "big") % 256] += 1
        norm = math.sqrt(sum(x * x for x in want)) or 1
        assert all(math.isclose(a, b / norm, abs_tol=1e-6) for a, b in zip(vector, want, strict=True))
    rows = spark.createDataFrame([("ab",), (None,), ("abc",)], "t string").select("t", provided(F.col("t"), lambda batch: [[len(x), 1.0] for x in batch], prefix="q: ").alias("v"))
    assert {r.t: r.v for r in rows.collect()} == {"ab": [5.0, 1.0], None: None, "abc": [6.0, 1.0]}


def test_snapshot(spark, tmp_path):
    rows = thoughts(spark, {"content": 'quo"te\n', "created_at": datetime(2024, 1, 1, 0, 0, 0, 5), "confidence": 0.25, "pinned": True}, {"metadata_json": '{"a": [1]}'})
    v = vectors(spark, ("t0", [0.5, -1.25]))
    snapshot.export({"thought": rows, "edge": edges(spark, ("t0", "t1", "BRIDGE", 0.5)), "embedding": v.withColumn("owner_type", F.lit("thought"))}, f"file://{tmp_path}/s", "m", 2)
    assert tuple(snapshot.header(spark.read.text(f"file://{tmp_path}/s")).first()) == (21, "m", 2)
    good, bad = snapshot.restore(spark, f"file://{tmp_path}/s", "thought")
    got = {r.thought_id: r for r in good.collect()}
    assert got["t0"].content == 'quo"te\n' and got["t0"].created_at == datetime(2024, 1, 1, 0, 0, 0, 5) and got["t0"].pinned == 1 and got["t1"].metadata_json == '{"a": [1]}' and bad.count() == 0
    assert snapshot.restore(spark, f"file://{tmp_path}/s", "embedding")[0].first().vector == [0.5, -1.25] and snapshot.restore(spark, f"file://{tmp_path}/s", "edge")[0].count() == 1
    data = {"thought_id": "a", "thought_type": "NOTE", "essence": "e", "content": "c", "priority": "P1"}
    lines = [
        ({"_type": "thought", "data": data}, None), ({"_type": "thought", "data": {**data, "hack": 1}}, "unknown column"), ({"_type": "thought", "data": {**data, "priority": None}}, "missing column"), ({"_type": "thought", "data": {**data, "created_cycle": "x"}}, "value of another kind"),
        ({"_type": "thought", "data": {**data, "essence": 5}}, "value of another kind"), ({"_type": "thought", "data": {**data, "created_at": "soon"}}, "value of another kind"), ({"_type": "edge", "data": {}}, "other"), ({"_type": "thought"}, "no record"),
        ({"_type": "thought", "data": {**data, "created_at": "2024-01-01T02:00:00+02:00"}}, None),
    ]
    good, bad = snapshot.parsed(spark.createDataFrame([(json.dumps(x),) for x, _ in lines], "value string"), "thought")
    assert sorted(r.reason for r in bad.collect()) == sorted(w for _, w in lines if w not in (None, "other")) and sorted(str(r.created_at) for r in good.collect()) == ["2024-01-01 00:00:00", "None"]
    out, conflict = snapshot.merged(rows.select("thought_id"), spark.createDataFrame([("t0",), ("n",), ("m",), ("m",)], "thought_id string"), "thought_id")
    assert ids(out) == ["n", "t0", "t1"] and ids(conflict) == ["m", "t0"]
    with pytest.raises(ValueError):
        spark.createDataFrame([('{"_type": "metadata", "schema_version": 3}',)], "value string").write.text(f"file://{tmp_path}/old")
        snapshot.restore(spark, f"file://{tmp_path}/old", "thought")
    assert snapshot.portable(rows, edges(spark, ("t0", "t1", "BRIDGE", 0.5)), "DONE").count() == 1
    small = spark.createDataFrame([(1, 'a,"b'), (2, None)], "n int, t string").orderBy("n")
    assert json.loads(snapshot.formatted(small, "json")) == [{"n": 1, "t": 'a,"b'}, {"n": 2, "t": None}] and snapshot.formatted(small, "table").splitlines()[0] == "n  t" and snapshot.formatted(small, "csv").startswith("n,t\n1,")


def test_services(spark, tmp_path):
    services = Services(spark, f"file://{tmp_path}/all")
    assert services.list() == [] and not services.exists("one")
    services.write("one", "thought", thoughts(spark, {}))
    services.write("two-b", "thought", thoughts(spark, {}, {}))
    assert services.list() == ["one", "two-b"] and services.open("two-b").thought.count() == 2
    for name in ("One", "../one", "1a", ""):
        with pytest.raises(ValueError):
            services.exists(name)
    with pytest.raises(PermissionError):
        services.open("one").create_thought
    assert services.delete("one") and not services.delete("one") and services.list() == ["two-b"]


def test_conversations(spark, tmp_path):
    data = [{"question_id": "q", "question_type": "t", "question": "?", "answer": "Tea", "question_date": "d", "answer_session_ids": ["s1"], "extra": 1, "haystack_sessions": [{"session_id": "s0", "turns": [{"role": "user", "content": "hi"}]}, {"session_id": "s1", "turns": [{"role": "user", "content": "green TEA", "more": 2}, {"role": "assistant", "content": "ok"}]}]}]
    (tmp_path / "q.json").write_text(json.dumps(data))
    told = conversations.turns(conversations.questions(spark, f"file://{tmp_path}/q.json"))
    assert sorted((r.session_id, r.turn, r.content, r.has_answer) for r in told.collect()) == [("s0", 0, "hi", False), ("s1", 0, "green TEA", True), ("s1", 1, "ok", True)]
    assert [r.content for r in told.filter(conversations.substring_hit(F.lit("Tea"), F.col("content"))).collect()] == ["green TEA"] and told.filter(conversations.substring_hit(F.lit(""), F.col("content"))).count() == 0
    means = conversations.mean_scores(spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "question_type string, score double"))
    assert {(r.question_type, r.questions, round(r["mean"], 3)) for r in means.collect()} == {("a", 2, 0.5), ("b", 1, 1.0), (None, 3, 0.667)}
    one = spark.range(1).select(conversations.metadata("thought", lang="fr").alias("m")).first().m
    assert json.loads(one) == {"perspective": "thought", "source": {"is_self": True, "confidence": "high"}, "lang": "fr", "content_type": "natural_language"}
    with pytest.raises(ValueError):
        conversations.metadata("dream")


def test_derived_records(spark):
    rows = thoughts(spark, {"content": "a|b"}, {"content": "b|c"}, {"content": "a|b|c|d"}, {"content": "x"})
    made = edges(spark, ("t3", "t0", "DERIVED_FROM", 1.0))
    parts = F.split("content", r"\|")
    with pytest.raises(ValueError):
        D.derive(rows, parts, rows, made, most=3)
    new, links, tally = D.derive(rows, parts, rows, made, most=3, on_error="log")
    assert sorted(r.content for r in new.collect()) == ["a", "b", "c"] and links.count() == 4
    assert {r.thought_id: (r.created, r.reused, r.skipped) for r in tally.collect()} == {"t0": (2, 0, 0), "t1": (1, 1, 0), "t2": (0, 0, 4)}
    again = D.derive(rows, parts, rows.unionByName(new, allowMissingColumns=True), made.unionByName(links, allowMissingColumns=True), most=3, on_error="log")
    assert again[0].count() == 0 == again[1].count() and {r.thought_id: r.reused for r in again[2].collect()} == {"t0": 2, "t1": 2, "t2": 0}
    assert D.derive(rows, parts, rows, made, enabled=False)[0].count() == 0


def test_compiled_text():
    q = parse("FIND edges WHERE weight > 0.5 AND (edge_type = 'A' OR valid_within '2024-01-01' '2024-02-01') ORDER BY weight DESC")
    text, values = compiled(q, NOW)
    assert text == "SELECT * FROM edge WHERE weight > ? AND (edge_type = ? OR ((valid_from IS NULL OR valid_from < ?) AND (valid_until IS NULL OR valid_until > ?))) ORDER BY weight DESC LIMIT 100"
    assert values == [0.5, "A", "2024-02-01T00:00:00+00:00", "2024-01-01T00:00:00+00:00"]
    assert compiled(parse("COUNT thoughts"), NOW) == ("SELECT COUNT(*) AS count FROM thought", [])


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0)), (1, datetime(2024, 1, 1, 0, 10)), (1, datetime(2024, 1, 1, 2, 0)), (2, datetime(2024, 1, 2, 0, 0)), (3, datetime(2024, 1, 9, 0, 0))], "user_id long, ts timestamp_ntz")
    events.coalesce(1).write.parquet(f"file://{tmp_path}/e")
    spark.createDataFrame([(9, datetime(2024, 1, 30))], events.schema).write.mode("append").parquet(f"file://{tmp_path}/e")

    def result(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    counts = result(access.access_counts(access.events(spark, f"file://{tmp_path}/e")), "accesses")
    assert {(r.user_id, r.accesses) for r in counts.collect()} == {(1, 3), (2, 1), (3, 1)}
    sessions = result(access.sessions(access.events(spark, f"file://{tmp_path}/e")), "sessions")
    assert sorted((r.user_id, r.events) for r in sessions.collect()) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    entries = spark.createDataFrame([(1, "ADD"), (2, "ADD")], "sequence_number long, mutation_type string")
    entries.write.parquet(f"file://{tmp_path}/j")
    assert result(access.journal(spark, f"file://{tmp_path}/j", entries.schema), "journal").count() == 2
    assert [access.due(c, 5) for c in (0, 4, 5, 10)] == [False, False, True, True]
    cycle = access.HighWater(thoughts(spark, {"updated_cycle": 4}), edges(spark).withColumn("created_cycle", F.lit(None).cast("long")))
    assert cycle() == 4 == cycle()


def test_reads(spark):
    rows = thoughts(spark, {"visibility": "private", "updated_cycle": 5}, {"visibility": None, "updated_cycle": 5}, {"updated_cycle": 9, "expires_at": NOW}, {"updated_cycle": 1, "lifecycle_status": "ARCHIVED"})
    got = lambda **how: [r.thought_id for r in reads.list_thoughts(rows, NOW, **how).collect()]
    assert got() == ["t0", "t1", "t3"] and got(include_expired=True, limit=1) == ["t2"] and got(exclude_visibility="private") == ["t1", "t3"] and got(min_cycle=2, max_cycle=8, offset=1) == ["t1"]
    assert reads.count_thoughts(rows, NOW, lifecycle_status="ACTIVE").first()[0] == 2
    e = edges(spark, ("t0", "t1", "A", 0.1), ("t1", "t0", "A", 0.9), ("t0", "t2", "A", 0.5))
    assert [r.edge_id for r in reads.get_edges(e, "t0").collect()] == ["e1", "e2", "e0"] and [r.edge_id for r in reads.get_edges(e, "t0", "OUT", 1).collect()] == ["e2"] and ids(reads.get_edges(e, "t0", "IN"), "edge_id") == ["e1"]
    with pytest.raises(ValueError):
        reads.get_edges(e, "t0", "UP")
    assert reads.max_cycle(rows.limit(0), e.withColumn("created_cycle", F.lit(None).cast("long"))).first()[0] == 0
    assert reads.get_thought(rows, "t1", lambda df: df.withColumn("essence", F.lit("seen"))).first().essence == "seen"


def test_segments(spark):
    df = spark.createDataFrame([(0, "one\n\n two \n \n\nthree"), (1, "one"), (2, None), (3, "a--b==a--"), (4, "x y  z w")], "i int, t string")
    got = lambda i, **how: [tuple(x) for x in df.filter(f"i = {i}").select(segments(F.col("t"), **how)).first()[0]]
    assert got(0) == [("one", 0, 3), ("two", 6, 9), ("three", 14, 19)] and got(1) == [] == got(2) == got(0, min_chars=100)
    assert got(3, boundary="(--|==)") == [("a", 0, 1), ("--", 1, 3), ("b", 3, 4), ("==", 4, 6), ("a", 6, 7), ("--", 7, 9)]
    assert got(4, mode="window", size=2, overlap=1, unit="word") == [("x y", 0, 3), ("y  z", 2, 6), ("z w", 5, 8)] and [c for c, _, _ in got(3, mode="window", size=4, overlap=2)] == ["a--b", "-b==", "==a-", "a--"]
    with pytest.raises(ValueError):
        segments(F.col("t"), mode="window", size=2, overlap=2)


def test_command_line(spark, tmp_path):
    services = Services(spark, f"file://{tmp_path}")
    rows = thoughts(spark, {"content": "green tea", "priority": "P1"}, {"content": "black tea"})
    entries = spark.createDataFrame([(1, "ADD", "t0", "{}"), (2, "ADD", "t1", "{}")], "sequence_number long, mutation_type string, target_id string, delta string")
    tables = {"thought": rows, "edge": edges(spark, ("t0", "t1", "A", 0.5)), "embedding": vectors(spark, ("t0", [1.0])), "action": spark.createDataFrame([], "action_id string, source_thought_id string"), "journal_entry": entries.join(S.append_journal(entries), "sequence_number")}
    for name, df in tables.items():
        services.write("default", name, df)
    say = lambda *args: run(spark, [f"file://{tmp_path}", "--format", "json", "--now", "2024-02-15", *args])
    assert json.loads(say("query", "COUNT thoughts WHERE priority = 'P1'")) == [{"count": 1}]
    assert [x["thought_id"] for x in json.loads(say("recall", "green"))] == ["t0"] and json.loads(say("verify"))[0]["valid"] is True
    assert {(x["kind"], x["n"]) for x in json.loads(say("info")) if x["type"] is None} == {("thought", 2), ("edge", 1)}
    assert say("export", f"file://{tmp_path}/out").startswith("written") and snapshot.restore(spark, f"file://{tmp_path}/out", "thought")[0].count() == 2
