"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space of every contract here: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: A word is a run of anything else (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """name, with underscores put in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one that setCheckpointDir set.

    Where neither is set a temporary folder serves a local master, as in tests; a cluster needs the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends, or with drop_written."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(drop_written, 0)
    _written.append((spark, path))
    return path


def drop_path(path: str) -> None:
    """Delete a path of the shared folder, also after the session has ended."""
    jvm = SparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    context = SparkContext._active_spark_context
    conf = context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()
    at.getFileSystem(conf).delete(at, True)


def written() -> int:
    """How many paths fresh_path has given: a mark for drop_written."""
    return len(_written)


def latest() -> str:
    return _written[-1][1]


def drop_written(since: int, *keep: str) -> None:
    """Delete the tables written since a mark, but for the paths in keep. Nothing that is read later may need them."""
    for spark, path in _written[since:]:
        if path not in keep:
            try:
                drop_path(path)
                _written.remove((spark, path))
            except Exception as e:  # noqa: BLE001  what can't be deleted mustn't keep the rest
                print(f"{path} is left behind: {type(e).__name__}", file=sys.stderr)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path there. Paths are as Hadoop prints them, not escaped."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def stripped(text: Column) -> Column:
    """text without its white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def attach(rows: DataFrame, groups: DataFrame, key: str, weight: str, n_rows: int) -> DataFrame:
    """rows inner-joined to groups, which has each key once, with weight as the number of its rows.

    A group of over n_rows/256 rows is hot. There are fewer than 256 of them whatever the data, so they are
    broadcast and their rows stay where they are; the rest meet in a shuffle in which no key has more than
    n_rows/256 rows. Both frames are read twice: pass written tables.
    """
    limit = max(64, n_rows // 256)
    hot = groups.filter(F.col(weight) > limit)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(groups.filter(F.col(weight) <= limit), key))


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs, written with a number of its own for each row, and the number's column: numbers made by a lazy plan could
    change between two reads. A number has that of the partition that wrote the row above its lowest 33 bits."""
    row = free(docs, "__row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def part_of(row: Column | str) -> Column:
    """The partition that wrote a row of numbered."""
    return F.shiftright(row, 33)


def beside(rows: DataFrame, row: str, told: DataFrame, use: Callable[[pa.RecordBatch, np.ndarray, pa.Table], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """rows with what is told of them: use(rows of one partition, their numbers, what is told of that partition) gives the result's rows.

    told has a column `part`, as of part_of, and any others. It is dealt by part and written, a folder for
    each, and a task that meets rows of a part reads its folder. So rows never move, whatever they hold, and
    nothing is broadcast: a task holds what is told of one written partition, and the plan is the same at
    every size. Written files survive lost executors.
    """
    path = fresh_path(rows.sparkSession, "told")
    told.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(path)
    where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where = where.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    none = told.drop("part").limit(0).toArrow()

    def read(part: int) -> pa.Table:
        system, at = open_path(f"{where}/part={part}")
        if system.get_file_info(at).type == fs.FileType.NotFound:
            return none
        return pq.read_table(at, filesystem=system, partitioning=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, none
        for batch in batches:
            number = batch.column(row).to_numpy()
            part = number >> 33
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=False):
                if part[a] != last:
                    last = int(part[a])
                    found = read(last)
                yield use(batch.slice(a, b - a), number[a:b], found)
        release_memory()

    return rows.mapInArrow(run, schema)


def without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """rows of numbered less those whose number is in gone (one column), without the number."""
    at = rows.columns.index(row)

    def use(batch: pa.RecordBatch, number: np.ndarray, told: pa.Table) -> pa.RecordBatch:
        keep = ~np.isin(number, told.column("gone").to_numpy())
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        names = [c for i, c in enumerate(batch.schema.names) if i != at]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    dropped = F.col(gone.columns[0])
    return beside(rows, row, gone.select(part_of(dropped).alias("part"), dropped.alias("gone")), use, rows.drop(row).schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of consecutive batches, sorted by key before, cut so that no key is in two of them."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        k = cols[key]
        cut = int(np.searchsorted(k, k[-1]))
        if cut == 0 and held and held[-1][key][-1] == k[-1]:
            held.append(cols)
            continue
        yield {n: np.concatenate([*(h[n] for h in held), c[:cut]]) for n, c in cols.items()}
        held = [{n: c[cut:] for n, c in cols.items()}]
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def release_memory() -> None:
    """Give what Arrow and the C library hold unused back to the system; Python workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded(df: DataFrame, key: Column, bound: int, size: Column | None = None, most: int = 0) -> DataFrame:
    """A seeded sample by key that holds about bound rows at most and, with a size, about `most` of it; all of df if that has less."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))).first()
    share = min(bound / max(n, 1), most / total if size is not None and total else 1.0)
    if share >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) < int(share * (1 << 40)))
