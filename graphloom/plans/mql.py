"""The declarative query language: text -> tokens -> plan -> Spark SQL with bound parameters.

FIND and COUNT over the four graph tables, raw read-only SELECT, EXPLAIN, and verbs that callers register.
A literal is cast to its column's type, and text that is no number matches nothing in a numeric column.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import TEMPORAL

#: Tables and their aliases, columns that a query may name, limits.
TABLES = {"thoughts": "thought", "thought": "thought", "edges": "edge", "edge": "edge", "embeddings": "embedding", "embedding": "embedding", "actions": "action", "action": "action"}
COLUMNS = {
    "thought": {
        "thought_id": "string", "thought_type": "string", "essence": "string", "content": "string", "priority": "string", "lifecycle_status": "string", "created_cycle": "bigint",
        "updated_cycle": "bigint", "source": "string", "confidence": "double", "source_type": "string", "visibility": "string", "confirmation_count": "bigint",
    },
    "edge": {"edge_id": "string", "from_thought_id": "string", "to_thought_id": "string", "edge_type": "string", "weight": "double", "created_cycle": "bigint", "source": "string", "decay_multiplier": "double"},
    "embedding": {"embedding_id": "string", "owner_type": "string", "owner_id": "string", "model_name": "string", "dimension": "int"},
    "action": {"action_id": "string", "source_thought_id": "string", "action_type": "string", "intent": "string", "status": "string", "verification_status": "string"},
}
DEFAULT_LIMIT, MAX_DEPTH, MAX_INT = 100, 256, (1 << 63) - 1
ARITY = {"valid_now": 0, "valid_at": 1, "valid_within": 2, "valid_between": 2}


class QueryError(ValueError):
    """A query that can't be parsed or names what it may not."""


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: str | int | float


@dataclass(frozen=True)
class OneOf:
    column: str
    values: tuple[str | int | float, ...]


@dataclass(frozen=True)
class Valid:
    kind: str
    at: tuple[datetime, ...]


@dataclass(frozen=True)
class Logic:
    op: str
    parts: tuple


@dataclass(frozen=True)
class Query:
    verb: str
    table: str | None = None
    where: Compare | OneOf | Valid | Logic | None = None
    order: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    offset: int | None = None
    explain: bool = False
    sql: str | None = None
    args: tuple[str, ...] = ()


_TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|(<=|>=|!=|[=<>(),])|([^\s'=<>!(),]+))")


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token: quoted string, operator or word. Key words inside quotes are just text."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read {text[at:at + 20]!r}")
        kind = "quoted" if m[1] is not None else "op" if m[2] else "word"
        out.append((kind, m[1][1:-1].replace("''", "'") if m[1] is not None else m[2] or m[3]))
        at = m.end()
    return out


def instant(text: str) -> datetime:
    """An ISO 8601 instant in UTC without a zone; one without a zone is read as UTC."""
    try:
        at = datetime.fromisoformat(text)
    except ValueError as e:
        raise QueryError(f"{text!r} is no ISO 8601 timestamp") from e
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


def number(word: str) -> str | int | float:
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            continue
    return word


class _Reader:
    def __init__(self, found: list[tuple[str, str]]) -> None:
        self.found, self.at = found, 0

    def peek(self) -> str | None:
        """The next token as an upper-case word or operator; a quoted string is never one."""
        return self.found[self.at][1].upper() if self.at < len(self.found) and self.found[self.at][0] != "quoted" else None

    def take(self, *, value: bool = False) -> tuple[str, str]:
        if self.at >= len(self.found):
            raise QueryError("the query ends too early")
        self.at += 1
        kind, text = self.found[self.at - 1]
        if kind == "op" or kind == "quoted" and not value:
            raise QueryError(f"unexpected {text!r}")
        return kind, text

    def eat(self, *words: str) -> bool:
        if tuple(self.found[self.at + i][1].upper() if self.at + i < len(self.found) and self.found[self.at + i][0] != "quoted" else None for i in range(len(words))) == words:
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.eat(word):
            raise QueryError(f"{word} expected")

    def value(self) -> str | int | float:
        kind, text = self.take(value=True)
        return text if kind == "quoted" else number(text)

    def either(self, depth: int = 0):
        parts = [self.both(depth)]
        while self.eat("OR"):
            parts.append(self.both(depth))
        return parts[0] if len(parts) == 1 else Logic("OR", tuple(parts))

    def both(self, depth: int):
        parts = [self.operand(depth)]
        while self.eat("AND"):
            parts.append(self.operand(depth))
        return parts[0] if len(parts) == 1 else Logic("AND", tuple(parts))

    def operand(self, depth: int):
        if depth >= MAX_DEPTH:
            raise QueryError("nested too deep")
        if self.eat("("):
            inner = self.either(depth + 1)
            self.need(")")
            return inner
        _, word = self.take()
        if word.lower() in ARITY:
            return Valid(word.lower(), tuple(instant(str(self.take(value=True)[1])) for _ in range(ARITY[word.lower()])))
        if self.eat("IN"):
            self.need("(")
            values = [self.value()]
            while self.eat(","):
                values.append(self.value())
            self.need(")")
            return OneOf(word, tuple(values))
        for op in ("<=", ">=", "!=", "=", "<", ">"):
            if self.eat(op):
                return Compare(word, op, self.value())
        raise QueryError(f"a condition on {word!r} expected")

    def whole(self, name: str) -> int:
        _, text = self.take()
        if not text.isdigit() or int(text) > MAX_INT:
            raise QueryError(f"{name} must be a whole number")
        return int(text)


def read_only(sql: str) -> str:
    """One SELECT statement, or an error. Comments and quoted text are left out of the test."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";")
    if ";" in bare:
        raise QueryError("one statement only")
    if not re.match(r"(?i)select\b", bare):
        raise QueryError("only SELECT may be run")
    return sql.strip().rstrip(";")


def parse(text: str, verbs: Mapping[str, object] = {}) -> Query:  # noqa: B006
    text = text.strip()
    explain = bool(re.match(r"(?i)explain\s", text))
    if explain:
        text = text[8:].strip()
    if re.match(r"(?i)select\b", text):
        return Query("SELECT", sql=read_only(text), explain=explain)
    r = _Reader(tokens(text))
    _, verb = r.take()
    if verb.upper() not in ("FIND", "COUNT"):
        if verb.upper() in {v.upper() for v in verbs}:
            return Query(verb.upper(), args=tuple(t for _, t in r.found[1:]), explain=explain)
        raise QueryError(f"unknown verb {verb!r}")
    _, name = r.take()
    if name.lower() not in TABLES:
        raise QueryError(f"unknown table {name!r}")
    table = TABLES[name.lower()]
    where = r.either() if r.eat("WHERE") else None
    order, limit, offset = [], None, None
    if verb.upper() == "FIND":
        if r.eat("ORDER", "BY"):
            while True:
                _, column = r.take()
                order.append((column, r.eat("DESC")) if not r.eat("ASC") else (column, False))
                if not r.eat(","):
                    break
        limit = r.whole("LIMIT") if r.eat("LIMIT") else None
        offset = r.whole("OFFSET") if r.eat("OFFSET") else None
    if r.at < len(r.found):
        raise QueryError(f"unexpected {r.found[r.at][1]!r}")
    return check(Query(verb.upper(), table, where, tuple(order), limit, offset, explain))


def check(q: Query) -> Query:
    """q if it names only columns that it may."""

    def columns(node) -> set[str]:
        if isinstance(node, Logic):
            return set().union(*map(columns, node.parts))
        if isinstance(node, Valid) and q.table not in ("thought", "edge"):
            raise QueryError(f"{q.table} has no valid time")
        return {node.column} if isinstance(node, Compare | OneOf) else set()

    for c in columns(q.where) | {c for c, _ in q.order}:
        if c not in COLUMNS[q.table]:
            raise QueryError(f"column {c!r} not allowed for {q.table!r}")
    return q


def condition(node, table: str, now: datetime) -> Column:
    if node is None:
        return F.lit(True)
    if isinstance(node, Logic):
        out = condition(node.parts[0], table, now)
        for part in node.parts[1:]:
            out = (out & condition(part, table, now)) if node.op == "AND" else (out | condition(part, table, now))
        return out
    if isinstance(node, Valid):
        return TEMPORAL[node.kind](*(node.at or (now,)))
    kind = COLUMNS[table][node.column]
    typed = lambda v: F.lit(v if kind == "string" and isinstance(v, str) else str(v)).try_cast(kind)
    left = F.col(node.column)
    if isinstance(node, OneOf):
        return left.isin(*[typed(v) for v in node.values])
    right = typed(node.value)
    return {"=": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[node.op]


def _stamp(at: datetime) -> str:
    return at.replace(tzinfo=UTC).isoformat()


def _clause(node, now: datetime) -> tuple[str, list]:
    """A condition as SQL text with a ? for each value, and the values in order."""
    if isinstance(node, Logic):
        parts = [_clause(p, now) for p in node.parts]
        return "(" + f" {node.op} ".join(text for text, _ in parts) + ")", [v for _, values in parts for v in values]
    if isinstance(node, OneOf):
        return f"{node.column} IN ({', '.join('?' * len(node.values))})", list(node.values)
    if isinstance(node, Compare):
        return f"{node.column} {node.op} ?", [node.value]
    at = [_stamp(t) for t in node.at or (now,)]
    if node.kind == "valid_between":
        return "(valid_from IS NOT NULL AND valid_from >= ? AND valid_until IS NOT NULL AND valid_until <= ?)", at
    upto = "<" if node.kind == "valid_within" else "<="
    # The interval must have begun by the window's end, and not have ended by its start.
    return f"((valid_from IS NULL OR valid_from {upto} ?) AND (valid_until IS NULL OR valid_until > ?))", [at[-1], at[0]]


def compiled(q: Query, now: datetime) -> tuple[str, list]:
    """(SQL text, values of its parameters) of a query, without running it."""
    if q.verb == "SELECT":
        return q.sql, []
    if q.verb not in ("FIND", "COUNT"):
        return q.verb, list(q.args)
    text, values = _clause(q.where, now) if q.where is not None else ("", [])
    if isinstance(q.where, Logic) and q.where.op == "AND":
        text = text[1:-1]
    where = f" WHERE {text}" if text else ""
    if q.verb == "COUNT":
        return f"SELECT COUNT(*) AS count FROM {q.table}{where}", values
    order = f" ORDER BY {', '.join(f'{c} DESC' if down else f'{c} ASC' for c, down in q.order)}" if q.order else ""
    offset = f" OFFSET {q.offset}" if q.offset is not None else ""
    return f"SELECT * FROM {q.table}{where}{order} LIMIT {DEFAULT_LIMIT if q.limit is None else q.limit}{offset}", values


@dataclass
class Engine:
    """Runs queries over a graph's tables; verbs are functions of (engine, arguments) that return a DataFrame."""

    spark: SparkSession
    tables: Callable[[str], DataFrame]
    now: datetime
    verbs: dict[str, Callable[[Engine, tuple[str, ...]], DataFrame]] = field(default_factory=dict)

    def run(self, text: str, params: list | None = None) -> DataFrame:
        q = parse(text, self.verbs)
        if q.explain:
            sql, bound = compiled(q, self.now)
            return self.spark.createDataFrame([(q.verb, sql, json.dumps(bound if params is None else params))], "command string, sql string, params string")
        return self._frame(q, params)

    def _frame(self, q: Query, params: list | None) -> DataFrame:
        if q.verb == "SELECT":
            return self.select(q.sql, params)
        if q.verb not in ("FIND", "COUNT"):
            return self.verbs[next(v for v in self.verbs if v.upper() == q.verb)](self, q.args)
        df = self.tables(q.table).filter(condition(q.where, q.table, self.now))
        if q.verb == "COUNT":
            return df.agg(F.count("*").alias("count"))
        if q.order:
            df = df.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in q.order])
        if q.offset:
            df = df.offset(q.offset)
        return df.limit(DEFAULT_LIMIT if q.limit is None else q.limit)

    def select(self, sql: str, params: list | None = None) -> DataFrame:
        """One read-only SELECT over the tables, which it sees as temporary views."""
        sql = read_only(sql)
        for name in sorted(set(TABLES.values())):
            if re.search(rf"(?i)\b{name}\b", sql):
                self.tables(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=params or [])
