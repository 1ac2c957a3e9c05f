"""Quality classifier: a byte-level convolutional network in numpy.

A document is a string of bytes. Learned filters, each with a weight vector of its own for each of KERNEL bytes,
are applied to the bytes' learned embeddings at every byte. A chunk is CHUNK bytes, and one starts every STRIDE
bytes; a filter's response to it is the mean, over its bytes, of what is above zero. Each filter's largest
response over all chunks of the whole document enters a logistic layer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table
from .language_id import _by_length, held_out

CHUNK, STRIDE, WIDTH, FILTERS, KERNEL = 64, 32, 8, 24, 8
#: Bytes up to which a short document is filled with PAD.
FILL, PAD = 256, 256
#: Labelled documents that are learned from, about, and bytes of their whole texts, at most; steps and documents a step, the same for any input.
SAMPLE, SAMPLE_BYTES, STEPS, BATCH, SEED = 4000, 32 << 20, 300, 48, 11
THRESHOLD = 0.3


def chunks(raw: bytes) -> np.ndarray:
    """The document's bytes as whole strides; short ones are filled with PAD, the last stride with the document's start. A stride of PAD ends it."""
    b = np.frombuffer(raw, np.uint8).astype(np.int16)
    short = max(0, FILL - len(b))
    fill = np.full(short, PAD, np.int16) if short else np.resize(b, -len(b) % STRIDE)
    return np.r_[b, fill, np.full(STRIDE, PAD, np.int16)]


class Network:
    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (257, WIDTH)).astype(np.float32),
            "filter": rng.normal(0, 0.4, (KERNEL * WIDTH, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.3, FILTERS).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }

    def convolve(self, b: np.ndarray) -> np.ndarray:
        """Each filter's response at each byte but those of the last stride, after the ReLU."""
        n = len(b) - STRIDE
        e = self.p["embed"][b[: n + KERNEL - 1]]
        seen = np.lib.stride_tricks.as_strided(e, (n, KERNEL * WIDTH), (e.strides[0], e.strides[1]))
        r = np.ascontiguousarray(seen) @ self.p["filter"]
        r += self.p["bias"]
        return np.maximum(r, 0, out=r)

    def respond(self, b: np.ndarray, block: int = 1 << 13) -> np.ndarray:
        """Each filter's response to each chunk of a run of strides, the last of which only ends it."""
        ends = range(0, len(b) - STRIDE, block)
        half = np.concatenate([self.convolve(b[k : k + block + STRIDE]).reshape(-1, STRIDE, FILTERS).sum(1) for k in ends])
        return (half[:-1] + half[1:]) / CHUNK

    def pooled(self, raw: bytes, block: int = 1 << 16) -> np.ndarray:
        """Each filter's largest response over the document, block by block."""
        b, most = chunks(raw), np.zeros(FILTERS, np.float32)
        for k in range(0, len(b) - 2 * STRIDE, block):
            most = np.maximum(most, self.respond(b[k : k + block + 2 * STRIDE]).max(0))
        return most

    def scores(self, raws: list[bytes]) -> np.ndarray:
        """Probabilities of a batch of documents, whose chunks are computed together."""
        parts = [chunks(r) for r in raws]
        out = np.empty(len(raws))
        at = 0
        while at < len(parts):
            to, size = at, 0
            while to < len(parts) and (to == at or size + len(parts[to]) <= 1 << 16):
                size += len(parts[to])
                to += 1
            if to == at + 1:
                most = self.pooled(raws[at])[None]
            else:
                n = np.array([len(x) // STRIDE for x in parts[at:to]])
                # Chunks that reach into a document's end or the next document are left out of the maximum.
                first = np.cumsum(n) - n
                r = self.respond(np.concatenate(parts[at:to]))
                r[np.r_[first[1:] - 2, first[1:] - 1]] = 0
                most = np.maximum.reduceat(r, first)
            out[at:to] = 1 / (1 + np.exp(-np.clip(most @ self.p["out"] + self.p["shift"], -30, 30)))
            at = to
        return out

    def train(self, raws: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> None:
        """Adam on the log loss, both labels drawn equally often; only the chunks that win the maximum over the whole text get a gradient."""
        rng = np.random.default_rng(seed)
        parts = [chunks(r) for r in raws]
        one, zero = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            picked = np.r_[rng.choice(one, batch // 2), rng.choice(zero, batch // 2)]
            g = {k: np.zeros_like(x) for k, x in self.p.items()}
            pull = np.zeros(KERNEL * 257 * FILTERS)  # of each byte at each place of each filter
            for i in picked:
                b = parts[i]
                all_ = self.respond(b)
                won = all_.argmax(0)
                hidden = all_[won, np.arange(FILTERS)]
                p = 1 / (1 + np.exp(-np.clip(float(hidden @ self.p["out"] + self.p["shift"][0]), -30, 30)))
                d = np.float32((p - y[i]) / batch)
                g["out"] += d * hidden
                g["shift"] += d
                # The bytes that the winning chunks' kernels see, and the responses there.
                seen = b[won * STRIDE + np.arange(CHUNK)[:, None] + np.arange(KERNEL)[:, None, None]]
                r = np.einsum("kcfw,kwf->cf", self.p["embed"][seen], self.p["filter"].reshape(KERNEL, WIDTH, FILTERS)) + self.p["bias"]
                back = (r > 0) * (d * self.p["out"] / CHUNK)
                g["bias"] += back.sum(0)
                key = (np.arange(KERNEL)[:, None, None] * 257 + seen) * FILTERS + np.arange(FILTERS)
                pull += np.bincount(key.ravel(), np.broadcast_to(back, key.shape).ravel(), KERNEL * 257 * FILTERS)
            by = pull.reshape(KERNEL, 257, FILTERS).astype(np.float32)
            g["filter"] += (self.p["embed"].T @ by).reshape(KERNEL * WIDTH, FILTERS)
            g["embed"] += (by @ self.p["filter"].reshape(KERNEL, WIDTH, FILTERS).transpose(0, 2, 1)).sum(0)
            for k, x in self.p.items():
                g[k] += 1e-4 * x
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                x -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network | float:
    """A network from the labelled rows' whole texts, a seeded sample of about `sample` rows and `sample_bytes` bytes at most;
    the labels' mean if there is one label only (0.5 without any).

    A label of several rows is their largest; null labels and null texts are left out.
    """
    y = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    used = bounded(y, F.col("id").cast("string"), sample)
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw")).filter("raw IS NOT NULL").join(F.broadcast(used), "id")
    rows = bounded(told, F.concat(F.col("id").cast("string"), F.lit("bytes")), 1 << 40, F.octet_length("raw"), sample_bytes).collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["raw"])))
    target = np.array([int(r["y"] > 0) for r in rows])
    if len(set(target.tolist())) < 2:
        return float(target.mean()) if len(target) else 0.5
    net = Network()
    net.train([bytes(r["raw"]) for r in rows], target)
    return net


def score(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row of docs, from whole texts. Null and empty texts are filled like short ones.

    Repeated rows and ties score alike, extra columns are not read, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                raws = [x or b"" for x in part.column(1).to_pylist()]
                found = shared.value.scores(raws) if isinstance(shared.value, Network) else np.full(len(raws), shared.value)
                yield pa.record_batch([part.column(0), pa.array(found)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 5, 0)
    model = fit(docs.filter(~out), table(spark, sf_dir, "labels").filter(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
