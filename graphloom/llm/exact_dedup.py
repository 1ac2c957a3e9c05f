"""Exact deduplication in two passes over Bloom filters of the hashes seen twice.

Each text's hash belongs to one of many filters, by its highest bits; their number grows with the rows, so a
filter always serves about ROWS of them with BITS bits. The first pass over a filter's hashes marks the
positions that are hit more than once, the second finds the hashes all of whose positions are marked: those
that may be repeated. Only hashes are sent to the filters, each once from a batch however often it occurs
there, and what comes back is told beside the rows. A row whose hash isn't repeated is unique and passes
straight through; only the others are shuffled, and compared by SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, beside, drop_written, latest, materialize, numbered, part_of, stripped, table, whole_groups, without, written

#: Rows that a filter serves, about, and its bits; both powers of two.
ROWS, BITS = 1 << 13, 1 << 17


def _positions(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two positions in a filter for each 64-bit hash, from bits that don't choose the filter."""
    h = h.view(np.uint64)
    return (h & np.uint64(BITS - 1)).astype(np.int64), (h >> np.uint64(20) & np.uint64(BITS - 1)).astype(np.int64)


def maybe_repeated(hashes: DataFrame, n_rows: int) -> DataFrame:
    """hashes (part, h), two longs -> (part, h) of those that may occur more than once, in any parts; some of them repeatedly."""
    bits = (n_rows // ROWS).bit_length()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, h = (c.to_numpy() for c in batch.columns)
            order = np.lexsort((h, part))
            part, h = part[order], h[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])]) if len(h) else np.empty(0, np.int64)
            times = np.diff(np.r_[first, len(h)])
            h = h[first]
            yield pa.record_batch([pa.array((h.view(np.uint64) >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int64)), pa.array(part[first]), pa.array(h), pa.array(times > 1)], names=["filter", "part", "h", "twice"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches, "filter"):
            starts = np.flatnonzero(np.r_[True, cols["filter"][1:] != cols["filter"][:-1]])
            for a, b in zip(starts, [*starts[1:], len(cols["h"])], strict=True):
                part, h, twice = cols["part"][a:b], cols["h"][a:b], cols["twice"][a:b].astype(bool)
                x, y = _positions(h)
                times = np.bincount(np.r_[x, y, x[twice], y[twice]], minlength=BITS)
                hit = (times[x] > 1) & (times[y] > 1)
                yield pa.record_batch([pa.array(part[hit]), pa.array(h[hit])], names=["part", "h"])

    sent = hashes.mapInArrow(send, "filter long, part long, h long, twice boolean")
    return sent.repartition("filter").sortWithinPartitions("filter").mapInArrow(probe, "part long, h long")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, sha, n_points, more columns) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(stripped(text).cast("binary"), 256).alias("sha"), F.char_length(text).cast("long").alias("n_points"), *more)


def told_apart(digests: DataFrame, row: str) -> tuple[DataFrame, int]:
    """(digests, written, with maybe: false if no other row has the sha; number of rows). Column row numbers the rows as numbered does."""
    n = digests.count()
    h = F.xxhash64("sha").alias("h")
    repeated = maybe_repeated(digests.select(part_of(row).alias("part"), h), n)
    rows = digests.withColumn("h", F.xxhash64("sha"))
    at = rows.columns.index("h")

    def use(batch: pa.RecordBatch, number: np.ndarray, told: pa.Table) -> pa.RecordBatch:
        maybe = np.isin(batch.column(at).to_numpy(), told.column("h").to_numpy())
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(maybe)], names=[*batch.schema.names[:at], "maybe"])

    schema = rows.drop("h").withColumn("maybe", F.lit(True)).schema
    return materialize(beside(rows, row, repeated, use, schema), "digest-told"), n


def _best(*more: str) -> Column:
    """What is smallest for the row that stays: most code points, then the smallest id, a null id last."""
    return F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), *more)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha) per row of docs.

    Null counts as empty text, and empty texts are equal. Of equal texts the row with the most code points,
    then the smallest id, stays. An id names a document: rows that repeat the kept one's id and length are
    that document, and each says kept. A null id comes last, and a group of null ids keeps its rows. Extra
    columns are not read. An empty table gives an empty result.
    """
    begin = written()
    rows, row = numbered(digest(docs, id_col, text_col), "digest")
    told, n = told_apart(rows, row)
    drop_written(begin, latest())
    single = told.filter("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    sent = told.filter("maybe").select("doc_id", "sha", "n_points")
    groups = materialize(sent.groupBy("sha").agg(F.min(_best()).alias("best"), F.count("*").alias("group_size")).select("sha", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("most"), "group_size"), "digest-groups")
    joined = attach(sent, groups, "sha", "group_size", n)
    return single.unionByName(joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("most"))).alias("kept"), "sha"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("sha", "text_sha256")


OP5_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs per text, equal as in exact_duplicates, whatever the ids: of rows that repeat an id and text one stays,
    a null id's row goes if another row has its text, and rows of one id with different texts are judged one by one.
    Other columns stay as they are, whatever their names. An empty table stays empty."""
    rows, row = numbered(docs, "digest-rows")
    begin = written()
    digests = materialize(digest(rows, id_col, text_col, F.col(row).alias("row")), "digest")
    sent = told_apart(digests, "row")[0].filter("maybe")
    drop_written(begin, latest())
    kept = sent.groupBy("sha").agg(F.min(_best("row")).alias("best")).select(F.col("best.row").alias("row"))
    return without(rows, row, sent.select("row").join(kept, "row", "left_anti"))
