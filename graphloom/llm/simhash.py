"""SimHash near-duplicates found around the anchor points of a covering code.

The 64 bits are cut into segments of 22, 22 and 20 bits. Of two fingerprints with at most 4 differing
bits, one of the first two segments differs in at most 1 bit or the third in none (2 + 2 + 1 > 4). Each
22-bit segment has as anchors the code words of the Hamming code of length 15 on its low bits, with its
other 7 bits free: every value is within covering radius 1 of exactly one anchor, its home. A value's
neighbours at distance 1 have their homes within radius plus threshold, 1 + 1, of it; it is replicated to
those anchors, 15 at most, and compared there. The third segment has every value as an anchor (radius 0).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, drop_written, latest, materialize, numbered, release_memory, table, whole_groups, without, written
from .components import connected_components

WIDTH, DISTANCE, SEED = 4, 4, 42
#: Groups up to this size are compared by shifted columns, others by sweeping; above the second, by choices of bands,
#: of which so many agree that fingerprints spread evenly would make parts of the third size. All find the same links.
_SMALL, _LARGE, _PART = 32, 4096, 64


def fingerprint(raw: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """SimHash of the text's shingles of width words, as unsigned 64 bits; 0 for no word."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - width + 1
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)), repeat(seed)), np.uint64, n
    )
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        votes += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, *more: Column) -> DataFrame:
    """(doc_id, fp, more long columns): one row per row of docs, fp the fingerprint's bits as a signed long."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *more)
    names = ["doc_id", "fp", *narrow.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x or b"", width) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], names=names)
        release_memory()

    return narrow.mapInArrow(run, ", ".join(f"{x} long" for x in names))


@lru_cache
def _anchors() -> np.ndarray:
    """For each 15-bit value: its home code word, then the homes of its neighbours at distance 1 (repeated up to 8)."""
    x = np.arange(1 << 15, dtype=np.int64)

    def home(v: np.ndarray) -> np.ndarray:
        syndrome = np.zeros_like(v)
        for bit in range(15):
            syndrome ^= np.where(v >> bit & 1, bit + 1, 0)
        return np.where(syndrome > 0, v ^ (1 << np.maximum(syndrome - 1, 0)), v)

    own = home(x)
    near = np.sort(np.stack([home(x ^ (1 << bit)) for bit in range(15)]), axis=0)
    out = np.repeat(own[:, None], 8, axis=1)
    filled = np.ones(len(x), np.int64)
    for i, row in enumerate(near):
        new = (row != own) & ((row != near[i - 1]) if i else True)
        out[x[new], filled[new]] = row[new]
        filled[new] += 1
    return out


def replicate(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor) of each replica; an anchor is its segment's number above its code word."""
    rows = np.arange(len(fp))
    index, anchor = [rows], [(2 << 32) + (fp >> 44 & 0xFFFFF)]
    for segment, shift in ((0, 0), (1, 22)):
        low, high = fp >> shift & 0x7FFF, (fp >> (shift + 15) & 0x7F) << 15
        near = _anchors()[low]
        keep = np.ones(near.shape, bool)
        keep[:, 1:] = near[:, 1:] != near[:, :1]
        i, _ = np.nonzero(keep)
        index.append(i)
        anchor.append((segment << 32) + (near[keep] | high[i]))
        for bit in range(7):
            index.append(rows)
            anchor.append((segment << 32) + (near[:, 0] | (high ^ (1 << (15 + bit)))))
    return np.concatenate(index), np.concatenate(anchor).astype(np.int64)


def sweep(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two lists of positions, of fp's graph of pairs within distance."""
    a, b, left = [], [], np.arange(len(fp))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= distance
            if near.any():
                found = left[near]
                a.append(np.full(len(found), at))
                b.append(found)
                frontier.extend(found)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def sweep_bands(fp: np.ndarray, segment: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Like sweep, for a large group around an anchor of a segment: edges that connect the same positions.

    The bits outside the segment are cut into bands, distance more than must agree: fingerprints within
    distance agree on one choice of that many bands at least, so only those that agree on a choice are swept
    together, and each choice adds a forest. The larger the group, the more bands must agree, so that the
    parts that are swept stay small however many fingerprints there are.
    """
    low, one = np.uint64((22, 44, 0)[segment]), np.uint64(1)
    rest = fp >> low | fp << (np.uint64(64) - low) if low else fp
    width, same = (44 if segment == 2 else 42), 1
    while same < 4 and len(fp) >> (width * same // (distance + same)) > _PART:
        same += 1
    cuts = np.linspace(0, width, distance + same + 1).astype(np.uint64)
    masks = [((one << (hi - lo)) - one) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for choice in combinations(masks, same):
        band = rest & np.bitwise_or.reduce(np.array(choice, np.uint64))
        order = np.argsort(band, kind="stable")
        cut = np.flatnonzero(np.diff(band[order])) + 1
        for lo, hi in zip(np.r_[0, cut].tolist(), np.r_[cut, len(order)].tolist(), strict=True):
            if hi - lo > 1:
                part = order[lo:hi]
                x, y = sweep(fp[part], distance)
                a.append(part[x])
                b.append(part[y])
    return np.concatenate(a), np.concatenate(b)


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """classes (fp, rep), each fp once. Edges (a, b) between reps that connect all fingerprints within distance.

    Within an anchor's group the links' spanning forest is returned, not all pairs. A task holds one
    anchor's group at a time: distinct fingerprints, so copies never add to it. Of N fingerprints a group
    has about 15 N / 2^18, 16 bytes each (46 MB at 5 * 10^10); more bands agree as it grows.
    """
    if distance > DISTANCE:
        raise ValueError(f"the segments cover up to {DISTANCE} differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            i, anchor = replicate(fp)
            for k in range(0, len(i), 1 << 17):
                part = i[k : k + (1 << 17)]
                yield pa.record_batch([pa.array(anchor[k : k + (1 << 17)]), pa.array(fp[part]), pa.array(rep[part])], names=["anchor", "fp", "rep"])
        release_memory()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches, "anchor"):
            anchor, fp, rep = cols["anchor"], cols["fp"].view(np.uint64), cols["rep"]
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            sizes = np.diff(np.r_[starts, len(anchor)])
            a, b = [], []
            small = np.repeat(sizes <= _SMALL, sizes)
            for shift in range(1, min(_SMALL, int(sizes.max()))):
                i = np.flatnonzero((anchor[shift:] == anchor[:-shift]) & small[shift:])
                if not len(i):
                    break
                i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= distance]
                a.append(i)
                b.append(i + shift)
            for g in np.flatnonzero(sizes > _SMALL):
                part = fp[starts[g] : starts[g] + sizes[g]]
                x, y = sweep(part, distance) if len(part) <= _LARGE else sweep_bands(part, int(anchor[starts[g]]) >> 32, distance)
                a.append(x + starts[g])
                b.append(y + starts[g])
            if a and len(i := np.concatenate(a)):
                yield pa.record_batch([pa.array(rep[i]), pa.array(rep[np.concatenate(b)])], names=["a", "b"])
        release_memory()

    replicas = classes.select("fp", "rep").mapInArrow(spread, "anchor long, fp long, rep long")
    dealt = replicas.repartition("anchor").sortWithinPartitions("anchor", "rep")
    return dealt.mapInArrow(compare, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(prints: DataFrame, node: str, distance: int, *more: Column) -> DataFrame:
    """(fp, n, component_id, more aggregates) per fingerprint; component_id is the smallest node reachable over links."""
    begin = written()
    classes = materialize(prints.groupBy("fp").agg(F.min(node).alias("rep"), F.count("*").alias("n"), *more), "simhash-classes")
    roots = connected_components(links(classes, distance), "simhash-links")
    out = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("root", "rep"))
    groups = materialize(out.drop("rep", "root"), "simhash-groups")
    drop_written(begin, latest())
    return groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs, component_id the smallest id reachable over links.

    Null and empty texts have fingerprint 0, which is linked like any other. Rows with a null id get their
    fingerprint, a null component_id, and link nothing. Repeated rows get the same result each. Extra
    columns are not read. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    known = prints.filter("doc_id IS NOT NULL")
    groups = components(known, "doc_id", distance)
    total = prints.count()
    return (
        attach(known, groups, "fp", "n", total)
        .select("doc_id", "fp", "component_id")
        .unionByName(prints.filter("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs per component of near duplicates, the one with the smallest id. Rows are linked by number, so
    rows of a null id, which come last, and rows that repeat an id are linked and dropped like any other. Rows without
    a word have fingerprint 0, and one of them stays. Other columns stay as they are, whatever their names. An empty table stays empty."""
    rows, row = numbered(docs, "simhash-rows")
    prints = materialize(fingerprints(rows, id_col, text_col, WIDTH, F.col(row).alias("row")), "simhash")
    best = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), "row")
    groups = components(prints, "row", DISTANCE, F.min(best).alias("best"))
    kept = groups.groupBy("component_id").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    return without(rows, row, prints.select("row").join(kept, "row", "left_anti"))
