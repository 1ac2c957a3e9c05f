"""Vectors for texts: a bag of hashed words as plain Columns, and a caller's own provider."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

PLACES = 256


def bag_of_words(text: Column, places: int = PLACES) -> Column:
    """array<float> of unit length: each word, a run of letters and digits, adds 1 at the place that its SHA-1 names. All 0 without a word."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    at = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.sha1(w), 1, 8), 16, 10).cast("long"), F.lit(places)).cast("int"))

    def unit(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))

    # Places in order, each with how often it comes: the length of its run.
    def counted(sorted_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda p: F.size(F.filter(sorted_, lambda x: x == p)).cast("double"))

    return let(let(at, counted), unit)


def provided(text: Column, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], prefix: str = "") -> Column:
    """array<float> from a provider that takes a batch of texts, each with the prefix of its role (query or document) in front."""

    @F.pandas_udf("array<float>")
    def run(texts):
        import pandas as pd

        found = iter(embed([prefix + t for t in texts if t is not None]) if texts.notna().any() else ())
        return pd.Series([None if t is None else list(map(float, next(found))) for t in texts], dtype=object)

    return run(text)
