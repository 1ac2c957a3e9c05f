"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived that every match satisfies. The
index has a posting (trigram, row) for each trigram of these queries and each text that contains it, in a
table sorted by trigram. A rule's postings are intersected and united by row, which gives its candidates; only
those are searched for it, and a rule without mandatory trigrams searches all texts. Texts aren't shuffled:
candidates are told to blocks of written partitions, each block's by a broadcast of bounded size.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import drop_written, free, fresh_path, materialize, part_of, table, written
from .quality_rules import let


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and not overlapping, whose group has least characters or more.

    A text in which probe isn't found has no such match; without a probe the pattern itself is looked for.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    probe: str | None = None


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
MORE = (
    Rule("github", r"gh[po]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("private_key", r"BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("slack", r"xox[bp]-[A-Za-z0-9-]{10,}"),
)
#: Alternatives of a literal that are told apart before the query is cut there; candidates that are broadcast for a block
#: of partitions, 16 bytes each, and blocks that are searched at a time.
_WAYS, BLOCK, _AT_A_TIME = 16, 1 << 20, 8

Terms = frozenset[frozenset[str]]  # any of these sets of trigrams, each with all of its members
_ANY: Terms = frozenset([frozenset()])


def _trigrams(literal: str) -> frozenset[str]:
    return frozenset(literal[i : i + 3] for i in range(len(literal) - 2))


def _both(a: Terms, b: Terms) -> Terms:
    return frozenset(x | y for x in a for y in b)


def trigram_query(pattern: str) -> Terms:
    """Sets of lower-case trigrams, one of which every text with a match of pattern contains in full (in lower case)."""
    from re import _constants as C
    from re import _parser as parser

    def seal(strings: set[str]) -> Terms:
        terms = frozenset(_trigrams(s) for s in strings)
        return _ANY if frozenset() in terms else terms

    def walk(items, strings: set[str], terms: Terms) -> tuple[set[str], Terms]:
        """strings: how the run of literals that ends here may read; terms: what is known of the text before it."""
        for op, arg in items:
            ways: set[str] | None = None
            if op is C.LITERAL:
                ways = {chr(arg).lower()}
            elif op is C.IN and len(arg) <= 4 and all(k is C.LITERAL for k, _ in arg):
                ways = {chr(v).lower() for _, v in arg}
            elif op is C.SUBPATTERN:
                strings, terms = walk(arg[3], strings, terms)
                continue
            elif op is C.BRANCH:
                parts = [walk(x, {""}, _ANY) for x in arg[1]]
                if all(t == _ANY for _, t in parts):
                    ways = set().union(*(s for s, _ in parts))
                else:
                    terms = _both(terms, seal(strings))
                    terms = _both(terms, frozenset().union(*(_both(t, seal(s)) for s, t in parts)))
                    strings = {""}
                    continue
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[:2] == (0, 1):
                inner, inside = walk(arg[2], {""}, _ANY)
                ways = inner | {""} if inside == _ANY else None
            if ways is not None and len(strings) * len(ways) <= _WAYS:
                strings = {a + b for a, b in product(strings, ways)}
                continue
            terms = _both(terms, seal(strings))
            strings = {""}
            if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                inner, inside = walk(arg[2], {""}, _ANY)
                terms = _both(terms, _both(inside, seal(inner)))
        return strings, terms

    strings, terms = walk(parser.parse(pattern), {""}, _ANY)
    return _both(terms, seal(strings))


class Queries:
    """The rules' queries over one numbered vocabulary of trigrams."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.terms = [trigram_query(r.pattern) for r in rules]
        #: Numbers of the rules that no trigram is mandatory for.
        self.full = [n for n, terms in enumerate(self.terms) if frozenset() in terms]
        self.trigrams = sorted(set().union(*(t for n, terms in enumerate(self.terms) if n not in self.full for t in terms)))

    def grams(self, text: Column) -> Column:
        """array<int>: the numbers of the vocabulary's trigrams that the text has, in lower case."""
        hit = lambda low: F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(self.trigrams)])
        return F.array_compact(let(F.lower(text), hit))

    def rules_of(self, gram: Column) -> Column:
        """Of the postings of one row: the numbers of the rules whose query they satisfy, as bits."""
        out = F.lit(0).cast("long")
        for n, terms in enumerate(self.terms):
            if n not in self.full:
                # A row has each trigram in one posting, so a term's trigrams are all there if as many postings are.
                whole = [F.count_if(gram.isin(*[self.trigrams.index(t) for t in term])) == len(term) for term in sorted(map(sorted, terms))]
                out = out.bitwiseOR(F.when(reduce(lambda a, b: a | b, whole), F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")))
        return out


def _running(steps: Column, block: int = 16, levels: int = 4) -> Column:
    """Sums of what stands before each element: sums in its block, and before it the running sums of whole blocks, found
    alike. Time grows in proportion to the elements: a level has a 16th of those below, and what is left after the last is short."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    if not levels:
        return F.transform(steps, lambda _, i: total(F.slice(steps, F.lit(1), i)))
    starts = F.sequence(F.lit(0), F.size(steps), F.lit(block))
    blocks = F.transform(starts, lambda k: total(F.slice(steps, k + 1, F.lit(block))))
    before = let(blocks, lambda b: _running(b, block, levels - 1))
    return let(before, lambda p: F.transform(steps, lambda _, i: F.get(p, F.floor(i / block).cast("int")) + total(F.slice(steps, i - i % block + 1, i % block))))


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches, in code points."""

    def placed(found: Column) -> Column:
        # The pieces between the matches and the matches themselves make up the text.
        steps = F.transform(found["all"], lambda m, i: F.char_length(F.get(found["gap"], i)) + F.char_length(m))
        ends = let(steps, lambda s: F.zip_with(_running(s), s, lambda a, b: a + b))
        rows = F.transform(F.arrays_zip(ends.alias("end"), found["all"].alias("all"), found["part"].alias("part")), lambda x: F.struct((x["end"] - F.char_length(x["all"])).alias("start"), x["end"].alias("end"), F.char_length(x["part"]).alias("n")))
        kept = F.filter(rows, lambda x: x["n"] >= rule.least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    pattern = F.lit(rule.pattern)
    found = F.struct(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, 0).alias("all"), F.regexp_extract_all(text, pattern, rule.group).alias("part"))
    return F.when(F.regexp_like(text, F.lit(rule.probe or rule.pattern)), let(found, placed)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def index(docs: DataFrame, text_col: str, keep: list[str], queries: Queries) -> tuple[DataFrame, DataFrame]:
    """(rows, postings), both written: rows (kept struct, text, grams, row) with a number each, postings (gram, row) sorted by gram."""
    kept = F.struct(*[F.col(c) for c in keep if c != text_col], F.lit(0).alias("_" * 64)).alias("kept")
    grams = queries.grams(F.coalesce(F.col(text_col), F.lit("")))
    rows = materialize(docs.select(kept, F.col(text_col).alias("text"), grams.alias("grams"), F.monotonically_increasing_id().alias("row")), "secrets-rows")
    postings = rows.select(F.explode("grams").alias("gram"), "row")
    return rows, materialize(postings.repartitionByRange("gram", "row").sortWithinPartitions("gram", "row"), "secrets-postings")


def candidates(postings: DataFrame, queries: Queries) -> DataFrame:
    """(row, rules), written: the rows that some indexed rule's query finds, and those rules as bits. A row has a posting a trigram at most."""
    return materialize(postings.groupBy("row").agg(queries.rules_of(F.col("gram")).alias("rules")).filter("rules != 0"), "secrets-candidates")


def _blocks(found: DataFrame, most: int) -> list[tuple[int, int | None]]:
    """Ranges of written partitions, the last one open, that have at most `most` candidates each, or are one partition."""
    cuts, held = [0], 0
    # A row for each written partition.
    for part, n in sorted(tuple(r) for r in found.groupBy(part_of("row").alias("part")).count().collect()):
        if held and held + n > most:
            cuts.append(part)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], None], strict=True))


def scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = (*BASE, *MORE), into: str = "__spans", keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """The columns `keep` of docs, all by default, and a column (`into`): array<struct<start, kind, end>>, kind the rule's
    number, by start, then kind.

    Null and empty texts have no span. Places count code points. Each row is searched alone: ties, repeated
    rows, null ids and other columns change nothing, and an empty table stays empty. A column that has the
    name `into` already is an error. The index and the rows are written and go when the result is; a task holds
    a text's spans, and what is broadcast are the candidates of a block of partitions, `block` rows at most or one partition's.
    """
    if free(docs, into) != into:
        raise ValueError(f"there is a column {into!r} already")
    begin, keep, queries = written(), docs.columns if keep is None else keep, Queries(rules)
    rows, postings = index(docs, text_col, keep, queries)
    found = candidates(postings, queries)
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def found_by(number: int, rule: Rule) -> Column:
        kind = F.lit(number).alias("kind")
        spans = F.transform(spans_of(text, rule), lambda x: F.struct(x["start"].alias("start"), kind, x["end"].alias("end")))
        return spans if number in queries.full else F.when(F.col("rules").bitwiseAND(F.lit(1 << number)) != 0, spans).otherwise(none)

    columns = [F.col("text").alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in keep]
    spans = F.array_sort(F.concat(none, *[found_by(n, r) for n, r in enumerate(rules)])).alias(into)
    path = fresh_path(docs.sparkSession, "secrets")

    def search(at: tuple[int, tuple[int, int | None]]) -> tuple[str, StructType]:
        number, (low, high) = at
        inside = (F.col("row") >= low << 33) & (F.lit(True) if high is None else F.col("row") < high << 33)
        told = rows.drop("grams").filter(inside).join(F.broadcast(found.filter(inside)), "row", "left")
        out = told.select(*columns, spans)
        out.write.parquet(f"{path}/{number}")
        return f"{path}/{number}", out.schema

    # Jobs of several blocks share the executors, so that a block's last tasks don't leave them idle.
    with ThreadPoolExecutor(_AT_A_TIME) as pool:
        done = list(pool.map(search, enumerate(_blocks(found, block))))
    drop_written(begin, path)
    return docs.sparkSession.read.schema(done[0][1]).parquet(*[x for x, _ in done])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (*BASE, *MORE)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.col("__spans")
    of = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scan(table(spark, sf_dir, "documents"), rules=rules, keep=["doc_id"]).select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(text(F.filter(spans, lambda x: x["kind"] < len(BASE))).cast("binary"), 256).alias("base_sha256"), text(spans).alias("spans"),
    )
