import pytest

from graphloom.plans.mql import Compare, Logic, OneOf, QueryError, Valid, parse, read_only


def test_and_binds_tighter_than_or():
    q = parse("FIND thoughts WHERE priority = 'P1' OR priority = 'P2' AND confidence > 0.5")
    assert q.where == Logic("OR", (Compare("priority", "=", "P1"), Logic("AND", (Compare("priority", "=", "P2"), Compare("confidence", ">", 0.5)))))


def test_key_words_in_quotes_are_text():
    q = parse("FIND thoughts WHERE source = 'x AND LIMIT ''5''' LIMIT 3")
    assert q.where == Compare("source", "=", "x AND LIMIT '5'") and q.limit == 3


def test_in_temporal_order_offset():
    q = parse("EXPLAIN FIND edges WHERE edge_type IN ('A', 'B') AND valid_at 2024-01-01T00:00:00+02:00 ORDER BY weight DESC, edge_id OFFSET 4")
    a, b = q.where.parts
    assert a == OneOf("edge_type", ("A", "B")) and isinstance(b, Valid) and b.at[0].isoformat() == "2023-12-31T22:00:00"
    assert q.explain and q.order == (("weight", True), ("edge_id", False)) and q.offset == 4


@pytest.mark.parametrize(
    "text",
    [
        "FIND nothing", "FIND thoughts WHERE valid_from = 'x'", "FIND thoughts WHERE priority IN ()", "FIND actions WHERE valid_now", "FIND thoughts LIMIT -1",
        "FIND thoughts WHERE valid_within '2024-01-01'", "FIND thoughts WHERE valid_at 'soon'", "DROP thoughts", "FIND thoughts WHERE (priority = 'P1'", "COUNT thoughts LIMIT 3",
    ],
)
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_one_read_only_statement():
    assert read_only("SELECT ';' AS x -- DROP; ") and parse("select 1").verb == "SELECT"
    for bad in ("SELECT 1; SELECT 2", "DELETE FROM thought", "WITH x AS (SELECT 1) INSERT INTO y SELECT * FROM x"):
        with pytest.raises(QueryError):
            read_only(bad)


def test_depth_limit():
    with pytest.raises(QueryError):
        parse("FIND thoughts WHERE " + "(" * 300 + "priority = 'P1'" + ")" * 300)
