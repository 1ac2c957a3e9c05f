"""Predicates over JSON columns: a path equals a scalar or is one of some."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
Scalar = str | int | float | bool | None
_PATH = re.compile(r"\$(\.[A-Za-z_][A-Za-z0-9_]*|\[\d+\])*")
MOST = 250


def _check(path: str) -> str:
    if not _PATH.fullmatch(path):
        raise ValueError(f"{path!r} is no path")
    return path


def equals(json: ColumnOrName, path: str, value: Scalar) -> Column:
    """The scalar at path equals value, with its type; None also matches a missing path; true is 1 and false 0."""
    _check(path)
    doc = F.try_parse_json(json)
    text = F.try_variant_get(doc, path, "string")
    if value is None:
        return text.isNull()
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    if isinstance(value, str):
        return F.coalesce((kind == "STRING") & (text == value), F.lit(False))
    as_number = F.when(kind == "BOOLEAN", F.try_variant_get(doc, path, "boolean").cast("int").cast("double")).when(kind != "STRING", F.try_variant_get(doc, path, "double"))
    return F.coalesce(as_number == F.lit(float(value)), F.lit(False))


def one_of(json: ColumnOrName, path: str, values: Sequence[Scalar]) -> Column:
    out = F.lit(False)
    for v in values:
        out |= equals(json, path, v)
    return out


def matches(json: ColumnOrName, predicates: Sequence[tuple[str, Scalar | tuple]], visible: Column | None = None) -> Column:
    """All predicates hold, and visible if given. A JSON text that is missing or malformed never matches."""
    if len(predicates) > MOST:
        raise ValueError(f"over {MOST} predicates")
    out = F.lit(True) if visible is None else visible
    for path, value in predicates:
        out &= one_of(json, path, value) if isinstance(value, tuple) else equals(json, path, value)
    return F.coalesce(F.try_parse_json(json).isNotNull() & out, F.lit(False))


def visible(json: ColumnOrName, path: str, allowed: Sequence[str], owner_path: str | None = None, owner: str | None = None) -> Column:
    """The visibility is one of allowed, or the owner is owner."""
    if not allowed and owner is None:
        raise ValueError("a visibility filter needs a value")
    out = one_of(json, path, allowed)
    return out | equals(json, owner_path, owner) if owner is not None else out
