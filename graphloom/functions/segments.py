"""Structural segments of a text with their places, by Python's regular expressions, whose match places Columns can't tell."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A blank line, between paragraphs.
BLANK_LINE = r"\n[ \t]*\n+"


def _trimmed(text: str, a: int, b: int) -> Iterator[tuple[str, int, int]]:
    part = text[a:b]
    core = part.strip()
    if core:
        start = a + len(part) - len(part.lstrip())
        yield core, start, start + len(core)


def paragraphs_of(text: str, boundary: str = BLANK_LINE) -> list[tuple[str, int, int]]:
    """Trimmed pieces between boundaries, and the groups that a boundary captures, each with its start and end; blank ones are left out."""
    out, at = [], 0
    for m in re.finditer(boundary, text):
        out += _trimmed(text, at, m.start())
        for g in range(1, (m.lastindex or 0) + 1):
            if m[g] is not None:
                out += _trimmed(text, *m.span(g))
        at = m.end()
    return [*out, *_trimmed(text, at, len(text))]


def windows_of(text: str, size: int, overlap: int, unit: str = "char") -> list[tuple[str, int, int]]:
    """Windows of so many characters or words that share `overlap` of them, up to the one that reaches the end."""
    spans = [(i, i + 1) for i in range(len(text))] if unit == "char" else [m.span() for m in re.finditer(r"\S+", text)]
    out = []
    for i in range(0, len(spans), size - overlap):
        last = min(i + size, len(spans)) - 1
        a, b = spans[i][0], spans[last][1]
        out.append((text[a:b], a, b))
        if last == len(spans) - 1:
            break
    return out


def segments(text: Column, mode: str = "paragraph", *, boundary: str = BLANK_LINE, size: int = 400, overlap: int = 100, unit: str = "char", min_chars: int = 0) -> Column:
    """array<struct<content, start, end>> of a text's paragraphs or windows; empty for null, for a text of fewer than min_chars
    characters between its blanks, and where there are fewer than two."""
    if mode not in ("paragraph", "window") or unit not in ("char", "word"):
        raise ValueError("paragraphs, or windows of chars or words")
    if not 0 <= overlap < size:
        raise ValueError("windows must move on")
    re.compile(boundary)

    def one(x: str | None) -> list[tuple[str, int, int]]:
        if x is None or len(x.strip()) < min_chars:
            return []
        found = paragraphs_of(x, boundary) if mode == "paragraph" else windows_of(x, size, overlap, unit)
        return found if len(found) > 1 else []

    @F.pandas_udf("array<struct<content:string,start:int,end:int>>")
    def run(texts):
        import pandas as pd

        return pd.Series([[{"content": c, "start": a, "end": b} for c, a, b in one(x)] for x in texts])

    return run(text)
