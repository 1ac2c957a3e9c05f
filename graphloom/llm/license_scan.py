"""License scans by a positional index of rare tokens, in DataFrame functions only.

The index holds license templates. A template's rare tokens are its words of the highest inverse document
frequency among templates; a posting says in which template and where in it a rare token stands. A file's
rare tokens are looked up, and postings are intersected by relative position: all tokens of one template
at one distance from their places in the file belong to one alignment. An alignment that covers enough of
its template is verified: the template's mandatory key phrase must stand at its place.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table
from .quality_rules import let

#: What separates words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A license label, the words of a notice, and the phrase of it that must stand where the notice has it."""

    label: str
    notice: str
    key: str


#: Phrases whose places are counted; their labels.
BASE = (Template("cc-by", "cc by", "cc by"), Template("gpl", "general public license", "general public license"), Template("reserved", "all rights reserved", "all rights reserved"))
TEMPLATES = (
    Template("agpl-3.0", "gnu affero general public license version 3", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "required by applicable law or agreed to in writing"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc0-1.0", "creative commons zero v1 0 universal", "creative commons zero"),
    Template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person obtaining a copy"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    *(Template(label, f"spdx license identifier {words}", f"spdx license identifier {words}") for label, words in (
        ("agpl-3.0", "agpl 3 0"), ("apache-2.0", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("cc-by-4.0", "cc by 4 0"), ("cc0-1.0", "cc0 1 0"),
        ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("isc", "isc"), ("lgpl", "lgpl"), ("mit", "mit"), ("mpl-2.0", "mpl 2 0"), ("unlicense", "unlicense"),
    )),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
#: Rare tokens of a template, and the share of their weight that an alignment must cover.
RARE, COVER = 4, 0.6
#: Function words and numerals are never rare tokens.
COMMON = frozenset("a an and any are as by for in into is of on or that the this to use with without under v v1 0 1 2 3 4".split())


def index(templates: tuple[Template, ...], rare: int = RARE) -> tuple[dict[str, list[tuple[int, int, float]]], list[float]]:
    """(rare token -> postings (template, place, weight), weight of each template's postings)."""
    words = [t.notice.split() for t in templates]
    df = Counter(w for x in words for w in set(x))
    idf = {w: math.log(1 + len(templates) / n) for w, n in df.items()}
    postings: dict[str, list[tuple[int, int, float]]] = {}
    total = []
    for t, x in enumerate(words):
        best = sorted({w for w in x if w not in COMMON}, key=lambda w: (-idf[w], w))[:rare]
        total.append(sum(idf[w] for w in x if w in best))
        for place, w in enumerate(x):
            if w in best:
                postings.setdefault(w, []).append((t, place, idf[w]))
    return postings, total


def words_of(text: Column) -> Column:
    """The text's words; no case of other letters than A-Z turns one of them into a separator, so lower() serves."""
    blank = lambda w, i: (F.element_at(w, i) == "").cast("int")
    return let(F.split(F.lower(text), SEPARATORS, -1), lambda w: F.slice(w, 1 + blank(w, 1), F.greatest(F.size(w) - blank(w, 1) - blank(w, -1), F.lit(0))))


def alignments(words: Column, templates: tuple[Template, ...]) -> Column:
    """array<struct<t, at, cover>> of the verified alignments: template, place of its first word, share of its weight covered."""
    postings, total = index(templates)
    rare = sorted(postings)
    keys = [t.notice.split().index(t.key.split()[0]) if not f" {t.key} " in f" {t.notice} " else len(f" {t.notice} ".partition(f" {t.key} ")[0].split()) for t in templates]
    by_word = F.map_from_arrays(
        F.array(*map(F.lit, rare)),
        F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(x).alias("x")) for t, p, x in postings[w]]) for w in rare]),
    )
    of = lambda values, t: F.get(F.array(*map(F.lit, values)), t)

    def intersect(pairs: Column) -> Column:
        same = lambda k: (F.get(pairs, k)["t"] == F.get(pairs, k - 1)["t"]) & (F.get(pairs, k)["at"] == F.get(pairs, k - 1)["at"])
        starts = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: (k == 0) | ~same(F.greatest(k, F.lit(1))))

        def runs(first: Column) -> Column:
            def run(k: Column, j: Column) -> Column:
                to = F.coalesce(F.get(first, j + 1), F.size(pairs))
                head = F.get(pairs, k)
                weight = F.aggregate(F.slice(pairs, k + 1, to - k), F.lit(0.0), lambda s, p: s + p["x"])
                return F.struct(head["t"].alias("t"), head["at"].alias("at"), (weight / of(total, head["t"])).alias("cover"))

            return F.transform(first, run)

        return let(starts, runs)

    def verified(found: Column) -> Column:
        phrase = lambda r: F.array_join(F.slice(words, r["at"] + of(keys, r["t"]) + 1, of([len(t.key.split()) for t in templates], r["t"])), " ")
        inside = lambda r: r["at"] + of(keys, r["t"]) >= 0
        # A weight of rare tokens summed in another order may fall short by a rounding.
        return F.filter(found, lambda r: F.when(inside(r) & (r["cover"] >= COVER - 1e-9), phrase(r) == of([t.key for t in templates], r["t"])).otherwise(F.lit(False)))

    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(*rare))
    pairs = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(by_word, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("at"), p["x"].alias("x")))))
    none = F.array().cast("array<struct<t:int,at:int,cover:double>>")
    return F.when(F.exists(words, lambda w: w.isin(*rare)), let(F.array_sort(pairs), lambda p: let(intersect(p), verified))).otherwise(none)


def scan(docs: DataFrame, text_col: str = "text", base: tuple[Template, ...] = BASE, templates: tuple[Template, ...] = TEMPLATES, into: str = "__license") -> DataFrame:
    """docs with a struct column (`into`): n_words, base (places of base phrases), found (verified alignments of templates), labels, score.

    Null and empty texts have no word and no label. score is 1 with a base phrase, else the largest cover.
    Each row is scanned alone: ties, repeated rows, null ids and other columns change nothing, and an empty
    table stays empty. A column that has the name `into` already is an error.
    """
    if free(docs, into) != into:
        raise ValueError(f"there is a column {into!r} already")
    every = (*base, *templates)

    def told(words: Column) -> Column:
        def summed(found: Column) -> Column:
            places = F.filter(found, lambda r: r["t"] < len(base))
            names = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda r: F.get(F.array(*[F.lit(t.label) for t in every]), r["t"]))))
            best = F.coalesce(F.array_max(F.transform(found, lambda r: F.least(r["cover"], F.lit(1.0)))), F.lit(0.0))
            return F.struct(
                F.size(words).cast("long").alias("n_words"), F.transform(places, lambda r: r["at"]).alias("base"), found.alias("found"),
                names(places).alias("base_labels"), names(found).alias("labels"), F.when(F.size(places) > 0, F.lit(1.0)).otherwise(best).alias("score"),
            )

        return let(alignments(words, every), summed)

    return docs.withColumn(into, let(words_of(F.coalesce(F.col(text_col), F.lit(""))), told))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("__license")
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", x["n_words"].alias("n_words"), F.size(x["base"]).cast("long").alias("n_base"),
        F.array_min(x["base"]).cast("long").alias("first_word"), F.array_max(x["base"]).cast("long").alias("last_word"),
        F.array_join(x["base_labels"], ",").alias("base_labels"), F.array_join(x["labels"], ",").alias("labels"), x["score"].alias("score"),
    )
