"""WARC archives with one gzip member per record, and a reader that splits them at any byte.

Records are written by Spark's own text writer, so that every file system and its commit protocol serve:
a line is a record's gzip member, and the separator between lines is an empty gzip member, which unpacks
to nothing. The reader cuts files into byte ranges. A task scans its range for gzip's magic number, checks
each candidate by unpacking the record's header, and reads the records that start inside its range,
wherever they end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, beside, drop_written, fresh_path, materialize, numbered, open_path, part_of, table, written

#: Bytes of a range, and of a read.
RANGE, READ = 64 << 20, 1 << 20
#: Payloads from this size on are written once; equal ones refer to the first.
LEAST_REVISIT = 0
#: An empty gzip member. Its bytes are ASCII but for two, which Latin-1 keeps.
_EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_MAGIC = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the page it repeats."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if refers_to is None else http
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> None:
    """Write a record per row of pages as gzip members in files under path.

    Null html is an empty payload. Of equal payloads of at least `least` bytes the row with the smallest id is
    the response; rows that repeat that id and payload are responses too, and others revisit it. Null ids come
    last and are named by an empty id. Extra columns are not written. An empty table writes empty files.
    Only (digest, id) pairs meet by payload, never the payloads.
    """
    begin, payload = written(), F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows, row = numbered(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")), "warc-pages")
    known = materialize(rows.filter(F.length("payload") >= least).select("id", F.sha1("payload").alias("sha"), F.col(row).alias("row")), "warc-digests")
    groups = known.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.filter("n > 1 AND first IS NOT NULL"), "warc-groups")
    repeats = attach(known, groups, "sha", "n", known.count()).filter("id IS NULL OR id != first")

    def members(batch: pa.RecordBatch, number: np.ndarray, told: pa.Table) -> pa.RecordBatch:
        first = dict(zip(told.column("row").to_pylist(), told.column("first").to_pylist(), strict=True))
        columns = [*batch.columns[:3], number.tolist()]
        out = []
        for k in range(0, batch.num_rows, 64):
            i, u, p = (c.slice(k, 64).to_pylist() for c in columns[:3])
            out += [_member(record(*x, base32_sha1(x[2]), first.get(n))) for *x, n in zip(i, u, p, columns[3][k : k + 64], strict=True)]
        return pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    lines = beside(rows, row, repeats.select(part_of("row").alias("part"), "row", "first"), members, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    drop_written(begin)


class _Bytes:
    """Reads of one file at any place, through the file system of its path."""

    def __init__(self, path: str) -> None:
        found, at = open_path(path)
        self.file = found.open_input_file(at)
        self.size = self.file.size()

    def at(self, place: int, n: int = READ) -> bytes:
        return self.file.read_at(min(n, max(0, self.size - place)), place)

    def __enter__(self) -> _Bytes:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def _unpack(file: _Bytes, place: int) -> tuple[bytes, int] | None:
    """The unpacked member that starts at place, and where it ends; None if none does, as told by its first bytes."""
    z = zlib.decompressobj(31)
    out, at, size = [], place, 0
    try:
        while not z.eof:
            data = file.at(at, 1 << 16 if at == place else READ)
            if not data:
                return None
            out.append(z.decompress(data))
            at += len(data)
            if not size and out[-1] and not out[0].startswith(b"WARC/"):
                return None
            size += len(out[-1])
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """(headers in lower case, block) of a record; None if data isn't one."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = headers.get("content-length", "")
    if not n.isdigit() or len(rest) < int(n):
        return None
    return headers, rest[: int(n)]


def records_in(file: _Bytes, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, block) of the records that start at start or later, and before end."""
    at, end = start, min(end, file.size)
    while at < end:
        window = file.at(at, min(READ, end - at) + 3)
        found = _MAGIC.search(window)
        if not found:
            at += max(1, len(window) - 3)
            continue
        place = at + found.start()
        if place >= end:
            return
        if window.startswith(_EMPTY, found.start()):
            at = place + len(_EMPTY)
            continue
        member = _unpack(file, place)
        told = member and parse(member[0])
        if told:
            yield place, *told
            at = member[1]
        else:
            at = place + 1


def read_archive(spark: SparkSession, path: str, span: int = RANGE) -> DataFrame:
    """(file, place, headers map, block binary, payload_bytes, payload_digest) of every record under path.

    The payload is what follows the HTTP headers in the block; its digest is computed from what was read. Files are listed with their sizes, cut into ranges of span bytes, and the ranges dealt over the tasks.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {span}L)")).alias("start"))
    n = ranges.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, size = [], 0
                with _Bytes(name) as file:
                    for x in records_in(file, start, start + span):
                        held.append((name, *x))
                        size += len(x[2])
                        if size >= 4 << 20:
                            yield _rows(held)
                            held, size = [], 0
                if held:
                    yield _rows(held)

    dealt = ranges.select("path", "start").repartitionByRange(max(1, n), "path", "start")
    return dealt.mapInArrow(run, _SCHEMA)


_SCHEMA = "file string, place long, headers map<string,string>, block binary, payload_bytes long, payload_digest string"


def _rows(held: list[tuple]) -> pa.RecordBatch:
    files, places, headers, blocks = zip(*held, strict=True)
    bodies = [block.partition(b"\r\n\r\n")[2] for block in blocks]
    columns = [
        pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array([list(x.items()) for x in headers], pa.map_(pa.string(), pa.string())),
        pa.array(blocks, pa.binary()), pa.array(map(len, bodies), pa.int64()), pa.array(map(base32_sha1, bodies), pa.string()),
    ]
    return pa.record_batch(columns, names=["file", "place", "headers", "block", "payload_bytes", "payload_digest"])


def _page(header: str) -> Column:
    found = F.regexp_extract(F.coalesce(F.col("headers")[header], F.lit("")), r"^<urn:page:(-?\d+)>$", 1)
    return F.when(found != "", found.cast("long"))


def payloads(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, damaged) of records of read_archive.

    A response's bytes and digest are those of the payload that was read, whatever its headers claim; damaged
    tells that they claim others. A revisit has no payload: its headers speak for the page it repeats.
    """
    head = lambda x: F.col("headers")[x]
    claimed, length = F.regexp_extract(F.coalesce(head("warc-payload-digest"), F.lit("")), "^sha1:(.*)$", 1), head("warc-payload-length").try_cast("long")
    response = head("warc-type") == "response"
    differs = ~(F.col("payload_bytes").eqNullSafe(length) & (F.col("payload_digest") == claimed))
    return records.select(
        _page("warc-record-id").alias("page_id"), F.when(response, F.col("payload_bytes")).otherwise(length).alias("payload_bytes"),
        F.when(response, F.col("payload_digest")).otherwise(claimed).alias("payload_digest"), head("warc-type").alias("record_type"),
        _page("warc-refers-to").alias("refers_to"), (response & differs).alias("damaged"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes an archive of pages into the shared folder and reads it back; the columns come from the records read."""
    path = fresh_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return payloads(read_archive(spark, path)).drop("damaged")


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
-- Five hexadecimal digits are four of base 32.
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, 1 + 5 * i, 5))::BIGINT) AS part FROM g)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(part, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x >> 15), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 10) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 5) & 31), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first THEN first END AS refers_to
FROM b
"""
