"""Language identification by rank-order profiles of letter n-grams (Cavnar and Trenkle)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table

#: N-grams of 1 to ORDER characters; ranks kept of a language and of a document.
ORDER, PROFILE, DOC_PROFILE = 3, 400, 300
#: Labelled documents that profiles are learned from, at most.
SAMPLE = 20_000
UNKNOWN = "und"
#: What stands for all that is no letter, smaller than any letter; bits of a code point in an n-gram.
_SPACE, _BITS = 32, 21


@lru_cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, each followed by a line end, and the text that each is of."""
    low = [(t or "").lower() for t in texts]
    n = np.fromiter(map(len, low), np.int64, len(low)) + 1
    return np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), np.repeat(np.arange(len(low)), n)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters' code points and spaces of all texts, runs of spaces as one, and the text that each is of."""
    points, doc = _points(texts)
    out = np.where(_letters()[points], points, _SPACE).astype(np.uint64)
    keep = np.r_[True, (out[1:] != _SPACE) | (out[:-1] != _SPACE) | (doc[1:] != doc[:-1])]
    return out[keep], doc[keep]


def _grams(sym: np.ndarray, doc: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, n-gram) of each order, with so many bits a symbol and the first symbol in the lowest."""
    for order in range(1, ORDER + 1):
        n = max(0, len(sym) - order + 1)
        gram = sym[:n].copy()
        for k in range(1, order):
            gram |= sym[k : n + k] << np.uint64(bits * k)
        same = doc[order - 1 :] == doc[:n]
        yield doc[:n][same], gram[same]


def ranked(sym: np.ndarray, doc: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, n-gram, rank) of each document's most frequent n-grams; ties by the n-gram's code.

    The symbols that occur are numbered from 1 in order, so that a document and an n-gram fit into 64 bits;
    where they don't, half the documents are ranked at a time.
    """
    alphabet, small = np.unique(sym, return_inverse=True)
    bits, docs = int(len(alphabet)).bit_length(), int(doc[-1]) - int(doc[0]) + 1 if len(doc) else 1
    width = ORDER * bits
    if docs > 1 and width + (docs - 1).bit_length() > 64:
        cut = int(np.searchsorted(doc, int(doc[0]) + docs // 2))
        return tuple(np.concatenate(x) for x in zip(ranked(sym[:cut], doc[:cut], top), ranked(sym[cut:], doc[cut:], top), strict=True))
    start, space = int(doc[0]) if len(doc) else 0, np.uint64(np.searchsorted(alphabet, _SPACE) + 1)
    parts = [((d - start).astype(np.uint64) << np.uint64(width) | g)[g != space] for d, g in _grams(small.astype(np.uint64) + np.uint64(1), doc, bits)]
    key, n = np.unique(np.concatenate(parts), return_counts=True)
    d, gram = (key >> np.uint64(width)).astype(np.int64), key & np.uint64((1 << width) - 1)
    order = np.argsort(d << 40 | (1 << 40) - 1 - n, kind="stable")
    d, gram = d[order], gram[order]
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.empty(0, np.int64)
    rank = np.arange(len(d)) - np.repeat(first, np.diff(np.r_[first, len(d)]))
    keep = rank < top
    d, gram, rank = d[keep], gram[keep], rank[keep]
    points = np.r_[np.zeros(1, np.uint64), alphabet]
    mask, out = np.uint64((1 << bits) - 1), np.zeros(len(gram), np.uint64)
    for k in range(ORDER):
        out |= points[(gram >> np.uint64(bits * k) & mask).astype(np.int64)] << np.uint64(_BITS * k)
    return d + start, out.astype(np.int64), rank


class Profiles:
    """Ranks of each language's n-grams: known has every profile's n-grams in order, and ranks a place for each and one for all others, with PROFILE where a language has no rank."""

    def __init__(self, langs: list[str], known: np.ndarray, ranks: np.ndarray) -> None:
        self.langs, self.known, self.ranks = langs, known, ranks

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sym, doc = symbols(texts)
        d, gram, rank = ranked(sym, doc, DOC_PROFILE)
        at = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
        at = np.where(self.known[at] == gram, at, len(self.known)) if len(self.known) else np.zeros(len(gram), np.int64)
        n = np.bincount(d, minlength=len(texts))
        away = np.stack([np.bincount(d, np.where(r[at] < PROFILE, np.abs(r[at] - rank), PROFILE), len(texts)) for r in self.ranks], 1)
        best = away.argmin(1)
        score = 1 - away[np.arange(len(texts)), best] / (PROFILE * np.maximum(n, 1))
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n > 0, np.clip(score, 0, 1), 0.0)


def learn(docs: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = SAMPLE) -> Profiles | None:
    """Profiles of the languages of docs, from a seeded sample of about `sample` rows at most. The driver gets
    each language's profile. Letters are told apart by code point, whatever their script. Ties go to the smaller code, and
    the first language by name. None without a labelled row."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    used = bounded(known, F.col("id"), sample).select("lang", "text")

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                langs = np.array(part.column(0).to_pylist(), object)
                texts = part.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    found = [g for _, g in _grams(*symbols([texts[i] for i in np.flatnonzero(langs == lang)]), _BITS)]
                    at, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    by: dict[str, list] = {}
    rank = F.expr("row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram)")
    summed = used.mapInArrow(grams_of, "lang string, gram long, n long").filter(f"gram != {_SPACE}").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for row in summed.withColumn("rank", rank).filter(f"rank <= {PROFILE}").collect():
        by.setdefault(row["lang"], []).append((row["gram"], row["rank"] - 1))
    if not by:
        return None
    langs = sorted(by)
    known = np.unique(np.array([gram for found in by.values() for gram, _ in found], np.int64))
    ranks = np.full((len(langs), len(known) + 1), PROFILE, np.int64)
    for i, lang in enumerate(langs):
        for gram, at in by[lang]:
            ranks[i, np.searchsorted(known, gram)] = at
    return Profiles(langs, known, ranks)


def identify(docs: DataFrame, profiles: Profiles | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row. score is 1 less the out-of-place distance as a share of the largest one.

    Null texts and texts without a letter are `und` with score 0; so is every text if no profile was learned.
    Repeated rows get the same result. Extra columns are not read. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                texts = part.column(1).to_pylist()
                langs, score = shared.value.predict(texts) if shared.value else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pa.record_batch([part.column(0), pa.array(langs), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def _by_length(batch: pa.RecordBatch, most: int = 1 << 20, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of the second column, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most))))
        yield batch.slice(at, to - at)
        at = to


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out("doc_id", 4, 2)
    profiles = learn(docs.filter(~out), "text", "lang", "doc_id")
    return identify(docs, profiles).select("doc_id", out.alias("held_out"), "lang_pred", "score")
