"""Every query equals its SQL in DuckDB on the smallest tables, and keeps its plan's shape."""

import duckdb
import pytest

import __spark_entry__
from graphloom.queries import ORACLE_SQL, QUERIES
from graphloom.sources.graph import Graph

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, DIR), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(sql.columns, sql.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_temporal_predicates_stay_in_the_scan(spark):
    plan = QUERIES["b12_valid_at_thought"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_columns_are_pruned(spark):
    plan = Graph(spark, DIR).thought.filter("priority = 'P1'").select("thought_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan
