"""Rule-based quality: one table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WORD, free, stripped, table

#: Frequent function words of the languages served.
STOP_WORDS = (
    "the and of to in is that for with be this on by as it are was or from have not "
    "der die und das ist den mit für von ein dem nicht auf zu im des sich auch als "
    "le la les de et des du un une en que est pour dans qui sur par au avec pas "
    "el los las del y por con para una su al se es lo como más esta"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if measure is below low or above high times the base measure (None: no bound)."""

    name: str
    measure: str
    base: str | None = None
    low: float | None = None
    high: float | None = None


#: The verdict's thresholds, beside the base's. Ratios are compared without division, so an empty text needs no case.
RULES = (
    Rule("length", "n_words", low=20, high=2_000_000),
    Rule("mean_word_length", "word_chars", base="n_words", low=1.5, high=20),
    Rule("symbol_ratio", "n_symbols", base="n_words", high=0.3),
    Rule("stop_word_ratio", "n_stop_words", base="n_words", low=0.02),
    Rule("shout_ratio", "n_bangs", base="n_words", high=0.3),
    Rule("duplicate_line_ratio", "n_dup_lines", base="n_lines", high=0.6),
)


#: Documents in which over this percentage of words repeats in windows of WINDOW words, or with fewer words, fail the base.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of width words found twice or more, the first included.

    Windows are compared by a 64-bit hash of their words' hashes. Only a text that repeats a window sorts
    them: each repeated window covers the words up to the next one's start, width at most.
    """

    def covered(windows: Column) -> Column:
        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(order: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width)))), F.lit(0), lambda s, x: s + x
            )

        return let(let(order, starts), total)

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    found = let(
        let(F.transform(words, lambda w: F.xxhash64(w)), windows),
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)),
    )
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(found).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Every measure as long, from a text that isn't null. n_words, n_repeat_words and n_stop_words share one split."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    stop = lambda w: F.lower(w).isin(*STOP_WORDS)
    of_words = let(
        word_array(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.size(F.filter(w, stop)).cast("long").alias("n_stop_words")),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "of_words": of_words,
        "of_lines": of_lines,
        "word_chars": F.char_length(stripped(text)).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_bangs": F.regexp_count(text, F.lit("!")).cast("long"),
    }


def verdict(value: Callable[[str], Column], rules: Sequence[Rule] = RULES) -> Column:
    """True where no rule fails."""
    out = F.lit(True)
    for rule in rules:
        base = value(rule.base) if rule.base else F.lit(1)
        if rule.low is not None:
            out &= value(rule.measure) >= base * rule.low
        if rule.high is not None:
            out &= value(rule.measure) <= base * rule.high
    return out


def score_documents(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, into: str = "__rules") -> DataFrame:
    """docs with a struct column (`into`) of all measures, base_failed and kept, by one projection without user functions.

    Null and empty texts have no word and fail. Each row is judged alone, so ties, repeated rows and null ids
    change nothing, and an empty table stays empty. Other columns stay as they are; one that has the name `into`
    already is an error. Repeated windows are told by a 64-bit hash.
    """
    if free(docs, into) != into:
        raise ValueError(f"there is a column {into!r} already")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def flat(m: Column) -> Column:
        fields = {n: m["of_words"][n] for n in ("n_words", "n_repeat_words", "n_stop_words")} | {n: m["of_lines"][n] for n in ("n_lines", "n_dup_lines")}
        fields |= {n: m[n] for n in ("word_chars", "n_symbols", "n_bangs")}
        failed = (fields["n_words"] < MIN_WORDS) | (100 * fields["n_repeat_words"] > MAX_REPEATED * fields["n_words"])
        kept = ~failed & verdict(fields.__getitem__, rules)
        return F.struct(*[c.alias(n) for n, c in fields.items()], failed.alias("base_failed"), kept.alias("kept"))

    return docs.withColumn(into, let(F.struct(*[c.alias(n) for n, c in measures(text).items()]), flat))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return told.select("doc_id", *[F.col("__rules")[n].alias(n) for n in names])


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs less those that the rules reject, as score_documents judges them. Columns stay as they are, whatever their names."""
    into = free(docs, "__rules")
    return score_documents(docs, text_col, into=into).filter(F.col(into)["kept"]).drop(into)


def _sql_rules() -> str:
    out = []
    for rule in RULES:
        base = rule.base or "1"
        out += [f"{rule.measure} >= {base} * {rule.low}::DOUBLE"] if rule.low is not None else []
        out += [f"{rule.measure} <= {base} * {rule.high}::DOUBLE"] if rule.high is not None else []
    return " AND ".join(out)


_STOP_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

#: With the view docs(doc_id, text) put in front.
MEASURES_SQL = rf"""
t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM docs),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS x, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM t WHERE len(w) >= {WINDOW}),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS n FROM dup) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM t),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_bangs,
  len(list_filter(w, lambda x: lower(x) IN ({_STOP_LIST})))::BIGINT AS n_stop_words, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
"""

OP3_SQL = f"WITH docs AS (SELECT doc_id, text FROM documents), {MEASURES_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_sql_rules()} AS kept FROM r"
