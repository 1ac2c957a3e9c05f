"""Mixing sources to target weights by fitting a subset sum to each source's budget.

A source whose target is over its size is taken whole once or twice; what is left of the budget is fitted
with whole documents. Documents are counted by exact length. But for a window of the budget's last words the
same share of each length is taken, rounded down; the largest lengths that still fit then bring the budget
into the window, and a bounded knapsack by dynamic programming over the sums that the remaining lengths reach
closes the rest. A window that doesn't reach the budget is widened, up to the whole budget or MOST_WORDS. How
many documents of a length are taken is thus known, and which ones follows from a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import attach, beside, drop_written, latest, materialize, numbered, part_of, table, whole_groups, word_count, written

WEIGHTS, TOTAL_SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, 17
#: Words that dynamic programming fits at first, and at most; hash buckets in which a length's documents are counted.
DP_WORDS, MOST_WORDS, BUCKETS = 1 << 14, 1 << 24, 1024


def targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size, n), each source once, with place k by code point, null last, and target.

    Shares of total_share of all sizes by weight, none above max_epochs times its size; the excess goes to
    the others by weight, until none is above. The driver gets sums only, a row for each round.
    """
    ordered, row = numbered(sizes.orderBy(F.col("source").asc_nulls_last()), "mix-sources")
    counts = sorted(ordered.groupBy(part_of(row).alias("part")).count().collect())
    starts = zip([r["part"] for r in counts], np.cumsum([0, *(r["count"] for r in counts)]).tolist(), strict=False)
    # A row for each partition of the sort.
    starts = F.broadcast(sizes.sparkSession.createDataFrame(list(starts), "part long, start long"))
    ordered = ordered.withColumn("part", part_of(row)).join(starts, "part").withColumn("k", F.col("start") + F.col(row) % (1 << 33))
    each = F.array(*[F.lit(float(w)) for w in weights])
    known = ordered.withColumn("weight", F.get(each, (F.col("k") % len(weights)).cast("int"))).drop(row, "part", "start")
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    all_ = known.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    total, weight, taken = total_share * all_[1], all_[0], 0.0
    while True:
        share = F.lit(total - taken) * F.col("weight") / F.lit(weight or 1.0)
        over = known.filter(share > cap).agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum(cap), F.lit(0.0))).first()
        # What is above stays above, as the shares of the others only grow.
        if all_[0] - over[0] == weight:
            return known.withColumn("target", F.least(share, cap)).drop("weight")
        weight, taken = all_[0] - over[0], over[1]
        if not weight:
            return known.withColumn("target", cap).drop("weight")


def _close(lengths: np.ndarray, counts: np.ndarray, left: int) -> np.ndarray:
    """Of each length how many to take so that they sum to left or as near below as can be, by dynamic programming."""
    take = np.zeros(len(lengths), np.int64)
    # Bit s of reached: some choice among the lengths so far sums to s; step[s] is the choice that first did.
    reached, mask, step, choices = 1, (1 << left + 1) - 1, np.full(left + 1, -1, np.int32), []
    for i in range(len(lengths) - 1, -1, -1):
        n, size, times = min(int(counts[i]), left // int(lengths[i])), int(lengths[i]), 1
        while n > 0 and not reached >> left:
            k = min(times, n)
            new = reached << (k * size) & mask & ~reached
            if new:
                bits = np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8)
                some = np.flatnonzero(bits)
                at, bit = np.nonzero(np.unpackbits(bits[some, None], axis=1, bitorder="little"))
                step[some[at] * 8 + bit] = len(choices)
                choices.append((i, k))
                reached |= new
            n, times = n - k, times * 2
        if reached >> left:
            break
    at = reached.bit_length() - 1
    while at:
        i, k = choices[step[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = DP_WORDS, most: int = MOST_WORDS) -> np.ndarray:
    """Of each length (ascending, over 0) how many to take so that they sum to budget or as near below as can be.

    No choice comes nearer for a budget of up to `most` words. A larger budget is reached by the widest window
    or missed by less than the shortest length that is left over; nothing is left to the window if a single
    document is longer than it.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    best = None
    while True:
        share = max(0, budget - window)
        take = np.array([int(c) * share // total for c in counts], np.int64)
        left = budget - int((lengths * take).sum())
        for room in (window // 2, 0):
            for i in range(len(lengths) - 1, -1, -1):
                if left <= window:
                    break
                more = min(int(counts[i] - take[i]), (left - room) // int(lengths[i]))
                if more > 0:
                    take[i] += more
                    left -= more * int(lengths[i])
        if left <= window:
            take += _close(lengths, counts - take, left)
        short = budget - int((lengths * take).sum())
        if best is None or short < best[0]:
            best = short, take
        if short == 0 or window >= min(budget, most):
            return best[1]
        window = min(8 * window, max(most, DP_WORDS))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    seed: int = SEED,
    row_col: str | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, epochs, row_col if given) per row of docs; epochs, 0 to 2, is how often the mix takes it.

    Null counts as empty text and as a source of its own, the last. Rows of one length and source are ranked
    by a hash of the id; rows that repeat an id are ranked one after the other, and null ids by their place in
    the table. Documents without a word are never taken. Extra columns are not read. An empty table gives an
    empty result. Lengths and their counts of one source are fitted in one task, documents never are.
    """
    begin = written()
    more = [] if row_col is None else [F.col(row_col).alias("row")]
    text_id = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("name"), word_count(F.col(text_col)).alias("size"),
            F.xxhash64(text_id, F.lit(seed)).alias("h"), *more,
        ).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")),
        "mix",
    )
    more = [c for c in rows.columns if c == "row"]
    sizes = rows.groupBy("name").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    known = targets(sizes.select(F.expr("CASE WHEN name != '' THEN substr(name, 2) END").alias("source"), "source_size", "n"), weights, total_share)
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("name")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    plan = known.select("k", name, "source_size", "n", "target", whole.alias("whole")).withColumn("budget", F.rint(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = materialize(plan, "mix-plan")
    n_rows = rows.count()
    keyed = materialize(attach(rows, plan, "name", "n", n_rows).drop("name", "n").withColumn("of", F.shiftleft("k", 32) + F.col("size")), "mix-rows")
    rows_path = latest()
    open_ = keyed.filter("size > 0 AND budget > 0")
    counted = materialize(open_.groupBy("k", "budget", "size", "of", "bucket").agg(F.count("*").alias("n")), "mix-lengths")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches, "k"):
            for k in np.unique(cols["k"]):
                at = cols["k"] == k
                take = fit(cols["size"][at], cols["n"][at], int(cols["budget"][at][0]))
                yield pa.record_batch([pa.array(cols["of"][at]), pa.array(take)], names=["of", "take"])

    per_length = counted.groupBy("k", "budget", "size", "of").agg(F.sum("n").alias("n"))
    taken = per_length.repartition("k").sortWithinPartitions("k", "size").mapInArrow(fitted, "of long, take long")
    before = W.partitionBy("of").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # The bucket in which a length's number is reached, and how many documents of that bucket are taken.
    here = F.expr("before < take AND take <= before + n")
    groups = materialize(
        counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(taken, "of")
        .groupBy("of")
        .agg(F.sum("n").alias("weight"), F.coalesce(F.max(F.when(here, F.col("bucket"))), F.lit(-1)).alias("cut"), F.max(F.when(here, F.col("take") - F.col("before"))).alias("part")),
        "mix-cuts",
    )
    chosen = materialize(attach(open_, groups, "of", "weight", n_rows), "mix-chosen")
    drop_written(begin, rows_path, latest())
    edge = chosen.filter("bucket = cut").withColumn("rank", F.row_number().over(W.partitionBy("of").orderBy("h", "doc_id", *more)))
    out = [
        chosen.filter("bucket != cut").withColumn("more", (F.col("bucket") < F.col("cut")).cast("int")),
        edge.withColumn("more", (F.col("rank") <= F.col("part")).cast("int")),
        keyed.filter("size = 0 OR budget = 0").withColumn("more", F.lit(0)),
    ]
    one = [x.select("doc_id", "size", "source_size", "target", (F.when(F.col("size") > 0, F.col("whole")).otherwise(0) + F.col("more")).alias("epochs"), *more) for x in out]
    return one[0].unionByName(one[1]).unionByName(one[2])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it, also where ids are null or repeated: rows are told by their number,
    and stay where they are. Other columns stay as they are, whatever their names. An empty table stays empty."""
    rows, row = numbered(docs, "mix-numbered")
    epochs = mix(rows, id_col, text_col, source_col, row_col=row).filter("epochs != 1")
    at = rows.columns.index(row)

    def use(batch: pa.RecordBatch, number: np.ndarray, told: pa.Table) -> pa.RecordBatch:
        which, times = told.column("row").to_numpy(), np.ones(len(number), np.int64)
        order = np.argsort(which)
        place = np.minimum(np.searchsorted(which, number, sorter=order), max(0, len(which) - 1))
        if len(which):
            found = order[place]
            times = np.where(which[found] == number, told.column("epochs").to_numpy()[found], 1)
        names = [c for i, c in enumerate(batch.schema.names) if i != at]
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        return pa.RecordBatch.from_arrays(columns, names=names).take(pa.array(np.repeat(np.arange(len(number)), times)))

    return beside(rows, row, epochs.select(part_of("row").alias("part"), "row", "epochs"), use, docs.schema)
