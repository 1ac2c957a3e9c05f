import hashlib
import itertools
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.functions.metadata import equals, matches, visible
from graphloom.functions.scoring import SEARCH_WEIGHTS, cosine, redistribute
from graphloom.functions.temporal import valid_at, valid_between, valid_within
from graphloom.operators import consolidation
from graphloom.operators import retrieval as R
from graphloom.operators import store as S
from graphloom.operators.graphs import components


def test_weights_are_conserved_for_every_combination():
    for n in range(6):
        for active in itertools.combinations(SEARCH_WEIGHTS, n):
            w = redistribute(SEARCH_WEIGHTS, set(active))
            total = sum(SEARCH_WEIGHTS[k] for k in active)
            assert math.isclose(sum(w.values()), 1.0 if total else 0.0)
            assert all(v == 0 for k, v in w.items() if k not in active)


def test_valid_time_bounds(spark):
    t = [None, datetime(2024, 1, 1), datetime(2024, 1, 10)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(itertools.product(t, t))], "i int, valid_from timestamp_ntz, valid_until timestamp_ntz")
    rows = [(r.valid_from, r.valid_until) for r in df.orderBy("i").collect()]
    for at in (datetime(2023, 12, 31), datetime(2024, 1, 1), datetime(2024, 1, 5), datetime(2024, 1, 10), datetime(2024, 1, 11)):
        want = [(a is None or a <= at) and (b is None or b > at) for a, b in rows]
        assert [r.ok for r in df.orderBy("i").select(valid_at(at).alias("ok")).collect()] == want
    lo, hi = datetime(2024, 1, 1), datetime(2024, 1, 10)
    assert [r.ok for r in df.orderBy("i").select(valid_within(lo, hi).alias("ok")).collect()] == [(a is None or a < hi) and (b is None or b > lo) for a, b in rows]
    assert [r.ok for r in df.orderBy("i").select(valid_between(lo, hi).alias("ok")).collect()] == [a is not None and b is not None and a >= lo and b <= hi for a, b in rows]


def test_metadata(spark):
    docs = ['{"a": 5, "b": true, "c": null}', '{"a": "5"}', '{"a": 5.0}', "{bad", None, '{"b": 1}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, j string")
    got = lambda c: [r.i for r in df.filter(c).orderBy("i").collect()]
    assert got(matches("j", [("$.a", 5)])) == [0, 2]
    assert got(matches("j", [("$.a", "5")])) == [1]
    assert got(matches("j", [("$.c", None)])) == [0, 1, 2, 5]
    assert got(matches("j", [("$.b", True)])) == [0, 5] == got(matches("j", [("$.b", 1)]))
    assert got(matches("j", [("$.a", ())])) == []
    assert got(matches("j", [], visible("j", "$.a", ("5",), "$.b", "x"))) == [1]
    with pytest.raises(ValueError):
        equals("j", "a.b", 1)


def test_cosine_of_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], [2.0, 4.0])], "z array<double>, x array<double>, y array<double>").select(cosine(F.col("z"), F.col("x")).alias("zero"), cosine(F.col("x"), F.col("y")).alias("one")).first()
    assert row.zero == 0.0 and math.isclose(row.one, 1.0)


def test_minmax_single_and_collapse(spark):
    one = spark.createDataFrame([("a", 3.0)], "thought_id string, score double")
    assert R.minmax(one, "score").first().score == 0.5
    found = spark.createDataFrame([("a", 1.0, "u"), ("b", 0.9, "u"), ("c", 0.8, None), ("d", 0.7, None), ("e", 0.9, "u")], "thought_id string, score double, unit string")
    assert sorted(r.thought_id for r in R.collapse(found, F.col("unit")).collect()) == ["a", "c", "d"]
    assert sorted(r.thought_id for r in R.collapse(found, F.col("unit"), 2).collect()) == ["a", "b", "c", "d"]


def test_components(spark):
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x1", "x2")]
    got = {r.thought_id: r.cluster_id for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert len(got) == 63 and {v for k, v in got.items() if k[0] == "n"} == {"n000"} and got["x2"] == "x1"


@pytest.mark.parametrize(("metadata", "want"), [('{"source": {"is_self": true}}', "external"), ('{"source": {"is_self": "true"}}', None), ('{"source": {"is_self": false}}', None), ('{"source": "me"}', None), ("{broken", None), (None, None)])
def test_a_cluster_of_own_records_is_not_external(spark, metadata, want):
    member = spark.createDataFrame([(i, "a") for i in "abc"], "thought_id string, cluster_id string")
    schema = "thought_id string, content string, source_type string, content_hash string, metadata_json string"
    thought = spark.createDataFrame([(i, f"text {i}", "OBSERVATION", i, metadata if i == "a" else None) for i in "abc"], schema)
    cohesive = spark.createDataFrame([("a", 1.0)], "cluster_id string, cohesion double")
    assert [r.rejected_by for r in consolidation.gates(member, thought, cohesive).collect()] == [want]


def test_journal_chains_a_whole_table(spark):
    """100,000 entries, more than a fold that copies the chain at each step can take, against a loop."""
    entries = spark.range(100_000).select((F.lit(100_000) - F.col("id")).alias("sequence_number"), F.lit("ADD").alias("mutation_type"), F.when(F.col("id") % 3 > 0, F.lit("d1")).alias("target_id"), F.when(F.col("id") % 5 > 0, F.lit("{}")).alias("delta"))
    chain = {r.sequence_number: (r.parent_hash, r.entry_hash) for r in S.append_journal(entries).collect()}
    last = None
    for r in sorted(entries.collect(), key=lambda r: r.sequence_number):
        own = hashlib.sha256(f"{r.sequence_number}|ADD|{r.target_id or ''}|{{}}|{last or ''}".encode()).hexdigest()
        assert chain.pop(r.sequence_number) == (last, own)
        last = own
    assert not chain and S.append_journal(entries.limit(0)).count() == 0
