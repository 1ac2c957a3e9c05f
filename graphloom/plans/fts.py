"""Keyword queries: what a text means, and the plan that finds and scores it.

A bare text is a bag of words, any of which may match. A text with balanced quotes, upper-case AND, OR or
NOT, or one of the column filters is an expression: phrases, prefixes, columns, parentheses, and words side
by side that must all match. A malformed expression is read once more as a bare text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR, TOKEN, fold, folded, let

#: Columns that a filter may name, operators.
FIELDS, OPERATORS = ("essence", "content"), ("AND", "OR", "NOT")


class MalformedError(ValueError):
    """An expression that can't be read."""


@dataclass(frozen=True)
class Phrase:
    """Words that stand one after the other, the last one only begun if prefix; in one column or in any."""

    words: tuple[str, ...]
    prefix: bool = False
    field: str | None = None


@dataclass(frozen=True)
class Logic:
    op: str
    parts: tuple


def is_expert(text: str) -> bool:
    """Whether a text asks for more than words: balanced quotes, an upper-case operator, or a column filter.

    An odd number of quotes is never meant as syntax, and a star alone isn't.
    """
    if text.count('"') % 2:
        return False
    bare = re.sub(r'"[^"]*"', " ", text)
    return '"' in text or any(w.strip("()") in OPERATORS for w in bare.split()) or any(re.match(rf"\(*({'|'.join(FIELDS)}):", w) for w in text.split())


def bare_terms(text: str) -> list[str]:
    """The words of a bare text in order: letters, digits, underscores and hyphens, stars at the end of a word kept."""
    terms = []
    for word in re.findall(r"[\w*-]+", text):
        star = word.endswith("*")
        core = word.strip("*").strip("-") if star else word.strip("-")
        if "*" in core or core in OPERATORS or "-" in core:
            core = f'"{core}"' + ("*" if star else "")
        elif core and star:
            core += "*"
        if core.strip('"*'):
            terms.append(core)
    return terms


def normalized(text: str) -> str:
    """The expression that a text stands for: a bare text's words joined by OR, an expert one's with hyphenated words quoted."""
    if not is_expert(text):
        return " OR ".join(bare_terms(text))
    out = []
    for quoted, word in re.findall(r'(\(*(?:(?:essence|content):)?"[^"]*"\S*)|(\S+)', text):
        if quoted or word.strip("()") in OPERATORS or re.fullmatch(r"[\w()*]+", word) or re.fullmatch(r"\(*(essence|content):[\w*]+\)*", word):
            out.append(quoted or word)
            continue
        head, field, core, tail = re.fullmatch(r"(\(*)((?:(?:essence|content):)?)(.*?)(\)*)", word).groups()
        if re.fullmatch(r"[\w-]+\*?", core):
            out.append(f"{head}{field}\"{core.rstrip('*')}\"{'*' if core.endswith('*') else ''}{tail}")
        else:
            out += [f"{head}{x}" if not i else x for i, x in enumerate(bare_terms(core))]
    return " ".join(out)


_PIECE = re.compile(r'\s*(?:(\()|(\))|((?:essence|content)\s*:)|"([^"]*)"(\*?)|([\w-]+)(\*?))')


def _read(text: str) -> Phrase | Logic:
    pieces, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _PIECE.match(text, at)
        if not m:
            raise MalformedError(text[at:])
        pieces.append(m)
        at = m.end()

    def word(i: int) -> str | None:
        return pieces[i][6] if i < len(pieces) and not pieces[i][7] else None

    def operand(i: int, field: str | None) -> tuple[Phrase | Logic, int]:
        if i >= len(pieces):
            raise MalformedError("the expression ends too early")
        m = pieces[i]
        if m[1]:
            inner, i = either(i + 1, field)
            if i >= len(pieces) or not pieces[i][2]:
                raise MalformedError(") expected")
            return inner, i + 1
        if m[3]:
            return operand(i + 1, m[3].rstrip(": "))
        if m[2] or word(i) in OPERATORS:
            raise MalformedError(m[0])
        raw = m[4] if m[4] is not None else m[6]
        words = tuple(w for w in re.split(r"[^\w-]+", raw) if w)
        return Phrase(words, bool(m[5] or m[7]), field), i + 1

    def juxtaposed(i: int, field: str | None) -> tuple[Phrase | Logic, int]:
        parts = []
        while True:
            part, i = operand(i, field)
            parts.append(part)
            if i >= len(pieces) or pieces[i][2] or word(i) in OPERATORS:
                return (parts[0] if len(parts) == 1 else Logic("AND", tuple(parts))), i

    # Words side by side bind tightest, then NOT, AND, OR.
    def level(op: str, below, i: int, field: str | None) -> tuple[Phrase | Logic, int]:
        left, i = below(i, field)
        while word(i) == op:
            right, i = below(i + 1, field)
            left = Logic(op, (left, right))
        return left, i

    def without(i: int, field: str | None) -> tuple[Phrase | Logic, int]:
        return level("NOT", juxtaposed, i, field)

    def both(i: int, field: str | None) -> tuple[Phrase | Logic, int]:
        return level("AND", without, i, field)

    def either(i: int, field: str | None) -> tuple[Phrase | Logic, int]:
        return level("OR", both, i, field)

    if not pieces:
        return Logic("OR", ())
    tree, i = either(0, None)
    if i < len(pieces):
        raise MalformedError(pieces[i][0])
    return tree


def parse(text: str) -> tuple[Phrase | Logic, bool]:
    """(tree, whether the expression was malformed and the text was read as a bare one)."""
    try:
        return _read(normalized(text)), False
    except MalformedError:
        return _read(" OR ".join(bare_terms(text))), True


def any_of(words: Sequence[str]) -> Logic:
    return Logic("OR", tuple(Phrase((w,)) for w in dict.fromkeys(words)))


def phrases(tree: Phrase | Logic) -> list[Phrase]:
    """Each phrase of a tree once, in order."""
    found = [tree] if isinstance(tree, Phrase) else [p for part in tree.parts for p in phrases(part)]
    return list(dict.fromkeys(p for p in found if p.words))


def matched(tree: Phrase | Logic, hit: dict[Phrase, Column]) -> Column:
    if isinstance(tree, Phrase):
        return hit.get(tree, F.lit(False))
    if not tree.parts:
        return F.lit(False)
    parts = [matched(p, hit) for p in tree.parts]
    if tree.op == "NOT":
        return parts[0] & ~parts[1]
    return reduce((lambda a, b: a & b) if tree.op == "AND" else (lambda a, b: a | b), parts)


def parts() -> Column:
    """A row's texts as they are searched."""
    return F.struct(*[folded(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in FIELDS])


def length() -> Column:
    """The tokens of both columns. Folding turns letters into letters, so the texts are counted as they are."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0)) for c in FIELDS])


def _possible(found: Sequence[Phrase], x: Column) -> Column:
    one = lambda p: reduce(lambda a, b: a | b, [F.contains(x[c], F.lit(fold(p.words[0]))) for c in FIELDS if p.field in (None, c)])
    return reduce(lambda a, b: a | b, [one(p) for p in found])


def possible(found: Sequence[Phrase]) -> Column:
    """Whether a row's text contains any phrase's first word, as letters anywhere: a cheap test that every match passes."""
    return let(parts(), lambda x: _possible(found, x))


def counts(found: Sequence[Phrase]) -> Column:
    """array<int>: how often each phrase stands in essence and content; null if no phrase's first word does. Texts are folded and split once."""
    def count(toks: Column, p: Phrase) -> Column:
        terms = [F.lit(fold(w)) for w in p.words]
        same = lambda w, i: F.startswith(w, terms[i]) if p.prefix and i == len(terms) - 1 else w == terms[i]
        if len(terms) == 1:
            return F.size(F.filter(toks, lambda w: same(w, 0)))
        rest = lambda k: reduce(lambda a, b: a & b, [F.coalesce(same(F.get(toks, k + i), i), F.lit(False)) for i in range(1, len(terms))])
        return F.size(F.filter(toks, lambda w, k: same(w, 0) & rest(k)))

    def of(toks: Column) -> Column:
        return F.array(*[reduce(lambda a, b: a + b, [count(toks[c], p) for c in FIELDS if p.field in (None, c)]) for p in found])

    split = lambda x: F.struct(*[F.split(x[c], SEPARATOR, -1).alias(c) for c in FIELDS])
    return let(parts(), lambda x: F.when(_possible(found, x), let(split(x), of)))
