"""Packing by vector bins: the dot-product heuristic under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_memory, table

TOKENS, SEGMENTS, END_ID = 2048, 64, 1
#: Ids that a task packs at a time, and the shortest piece that is cut to fill a sequence.
WINDOW_IDS, LEAST_PIECE = 1 << 21, 8
#: Bytes of text whose distinct words are coded together, and words that are merged at a time.
PART_BYTES, MERGE_WORDS = 1 << 21, 1 << 12
#: Words that are merged here: Latin or Cyrillic letters whose lower case is one letter, then a mark or none.
MARKS = ".,;:!?"
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-žЀ-џ]+[" + MARKS + "]?$"


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """The ids of many texts at a time, by the tokenizer's own rules.

    The tokenizer drops white space and treats what stands between apart, so a text's ids are its words' ids
    in order. Each distinct word is coded once per call and none is remembered: what is held follows from the
    texts of one call. Words of Latin or Cyrillic letters, with a punctuation mark or none at their end, are
    merged here, many at a time in numpy, by the tokenizer file's own vocabulary and merges; any other word is
    given to the library. Tests hold both to the library's ids.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab = model["vocab"]
        # The byte alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        letter = [chr(b) if b in plain else chr(next(other)) for b in range(256)]
        self.byte_id = np.array([[vocab[x], vocab[x + model["end_of_word_suffix"]]] for x in letter], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.shift, size = np.uint64(64 - 18), 1 << 18
        self.keys, self.rank, self.made = np.full(size, -1, np.int64), np.full(size, 1 << 30, np.int64), np.zeros(size, np.int64)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):  # open addressing, all keys a step at a time
            free = self.keys[slot[todo]] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot[todo], return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[slot[put]], self.rank[slot[put]], self.made[slot[put]] = key[put], put, made[put]
            todo = np.setdiff1d(todo, put)
            slot[todo] = np.where(self.keys[slot[todo]] >= 0, (slot[todo] + 1) & (size - 1), slot[todo])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id made) of pairs; pairs that don't merge have rank 1 << 30."""
        shape, key = key.shape, key.ravel()
        slot = self._slot(key)
        miss = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & (len(self.keys) - 1)
            miss = miss[(self.keys[slot[miss]] != key[miss]) & (self.keys[slot[miss]] >= 0)]
        return np.where(self.keys[slot] == key, self.rank[slot], 1 << 30).reshape(shape), self.made[slot].reshape(shape)

    def merge(self, data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and numbers of ids, of the words at data[at : at + n] (n over 0).

        At each step each word's first pair of the lowest rank is merged. A merged pair's second place dies;
        links to the next and previous living place spare moving the rest.
        """
        width = int(n.max())
        rows, col = np.arange(len(n)), np.arange(width)
        alive = col < n[:, None]
        raw = np.zeros(alive.shape, np.uint8)
        raw[alive] = data[spans(at, n)]
        ids = self.byte_id[raw, 0]
        ids[rows, n - 1] = self.byte_id[raw[rows, n - 1], 1]
        none = 1 << 30
        rank, made = np.full(alive.shape, none, np.int32), np.zeros(alive.shape, np.int32)
        pair = col[:-1] < n[:, None] - 1
        rank[:, :-1][pair], made[:, :-1][pair] = self._find(ids[:, :-1][pair] << 16 | ids[:, 1:][pair])
        after, ahead = np.tile(col + 1, (len(n), 1)), np.tile(col - 1, (len(n), 1))
        live = rows
        while len(live):
            best = rank[live].argmin(1)
            live, best = (x[rank[live, best] < none] for x in (live, best))
            if not len(live):
                break
            dead = after[live, best]
            follow = after[live, dead]
            ids[live, best] = made[live, best]
            alive[live, dead], rank[live, dead] = False, none
            after[live, best] = follow
            last = follow >= n[live]
            ahead[live[~last], follow[~last]] = best[~last]
            before = ahead[live, best]
            first = before < 0
            right, left = ~last, ~first
            rank[live[last], best[last]] = none
            r, m = self._find(np.concatenate([ids[live[right], best[right]] << 16 | ids[live[right], follow[right]], ids[live[left], before[left]] << 16 | ids[live[left], best[left]]]))
            k = int(right.sum())
            rank[live[right], best[right]], made[live[right], best[right]] = r[:k], m[:k]
            rank[live[left], before[left]], made[live[left], before[left]] = r[k:], m[k:]
        return ids[alive].astype("<u4"), alive.sum(1)

    def stems(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, number of ids) of distinct words that are merged here; the shortest are merged first."""
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        at, size = offsets[:-1], np.diff(offsets)
        data, found, n = np.frombuffer(data, np.uint8), [np.empty(0, "<u4")], np.zeros(len(words), np.int64)
        order = np.argsort(size, kind="stable")
        for k in range(0, len(order), MERGE_WORDS):
            part = order[k : k + MERGE_WORDS]
            ids, n[part] = self.merge(data, at[part], size[part])
            found.append(ids)
        begin = np.empty_like(n)
        begin[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(found), begin, n

    def code(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of distinct words, one word after the other."""
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.less_equal(pc.binary_length(words), 48))
        mask = plain.to_numpy(zero_copy_only=False)
        ours, others = np.flatnonzero(mask), np.flatnonzero(~mask)
        low = pc.utf8_lower(words.filter(plain))
        stem = pc.utf8_rtrim(low, MARKS)
        tail = (pc.binary_length(low).to_numpy() > pc.binary_length(stem).to_numpy()).astype(np.int64)
        coded = stem.dictionary_encode()
        flat, begin, count = self.stems(coded.dictionary)
        which = coded.indices.to_numpy()
        rest = [e.ids for e in self.tokenizer.encode_batch(words.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        n = np.zeros(len(words), np.int64)
        n[ours], n[others] = count[which] + tail, list(map(len, rest))
        out, start = np.empty(int(n.sum()), "<u4"), np.cumsum(n) - n
        out[spans(start[ours], count[which])] = flat[spans(begin[which], count[which])]
        marked = tail > 0
        marks = pc.utf8_slice_codeunits(low.filter(pa.array(marked)), -1).dictionary_encode()
        mark_ids = np.array([self.byte_id[ord(x), 1] for x in marks.dictionary.to_pylist()], "<u4")
        out[(start + n - 1)[ours[marked]]] = mark_ids[marks.indices.to_numpy()]
        out[spans(start[others], n[others])] = [i for ids in rest for i in ids]
        return out, n

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the place where each text's ids end. Null is empty."""
        texts = pc.fill_null(texts, "")
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        flat, n = self.code(coded.dictionary)
        index = coded.indices.to_numpy()
        each = n[index]
        ids = flat[spans((np.cumsum(n) - n)[index], each)]
        return ids, np.r_[0, np.cumsum(each)][words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of n numbers each, one span after the other."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)


def parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of rows whose strings in a column have most bytes together, or one row more."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(size, (size[at - 1] if at else 0) + most)) + 1
        yield batch.slice(at, to - at)
        at = to


_known: dict[str, WordIds] = {}


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: tuple[int, int, int], least: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (example, start, length) of examples with so many tokens and loss-bearing tokens.

    Loss-bearing tokens are an example's last ones. Full sequences are first cut from the front of long
    examples. What is left is packed bin by bin: the piece whose vector (tokens, segments, loss) has the
    largest dot product with the room left, each in parts of its limit, is placed as long as one fits; then,
    if at least `least` tokens are free, the front of the largest piece that is left is cut off to fill them.
    """
    limits = np.array(capacity, np.float64)
    out: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(tokens), np.int64)
    step = min(capacity[0], capacity[2])
    for i in np.flatnonzero(tokens >= step):
        while tokens[i] - start[i] >= step:
            out.append([(int(i), int(start[i]), step)])
            start[i] += step

    # Pieces that are alike lie on one pile; piles are in the order of their code, and so of their tokens.
    piles: dict[int, list[int]] = {}

    def code(i: int) -> int:
        left = int(tokens[i] - start[i])
        return left << 24 | min(left, int(loss[i]))

    for i in np.flatnonzero(tokens > start):
        piles.setdefault(code(int(i)), []).append(int(i))
    codes = np.array(sorted(piles), np.int64)
    vec = np.stack([codes >> 24, np.ones_like(codes), codes & 0xFFFFFF], 1).astype(np.float64)

    def top(k: int) -> int:
        nonlocal codes, vec
        c = int(codes[k])
        i = piles[c].pop()
        if not piles[c]:
            del piles[c]
            codes, vec = np.delete(codes, k), np.delete(vec, k, 0)
        return i

    while len(codes):
        room, here = limits.copy(), []
        while len(fits := np.flatnonzero((vec <= room).all(1))):
            k = int(fits[(vec[fits] @ (room / limits**2)).argmax()])
            v = vec[k].copy()
            i = top(k)
            here.append((i, int(start[i]), int(v[0])))
            room -= v
        free = int(min(room[0], room[2])) if room[1] >= 1 else 0
        if free >= least and len(codes):
            i = top(len(codes) - 1)
            here.append((i, int(start[i]), free))
            start[i] += free
            c = code(i)
            if c not in piles:
                at = int(np.searchsorted(codes, c))
                codes, vec = np.insert(codes, at, c), np.insert(vec, at, (c >> 24, 1, c & 0xFFFFFF), 0)
            piles.setdefault(c, []).append(i)
        out.append(here)
    return out


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss: Column | None = None,
    capacity: tuple[int, int, int] = (TOKENS, SEGMENTS, TOKENS),
    tokenizer: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset), ids as little-endian unsigned 32-bit numbers.

    capacity limits a sequence's tokens, pieces and loss-bearing tokens. loss gives a row's share of tokens,
    from its end, that bear loss (an instruction's answer); without it all but the first token do. Null and
    empty texts are their end id alone. Each row is an example of its own, so repeated rows and null ids are
    packed like any other. Extra columns are not read. An empty table gives an empty result. Tokenizing and
    packing are one pass without a shuffle; a task holds WINDOW_IDS ids and one document more at a time, and
    only a window's last sequences are short. Sequence ids have the partition's number in the upper bits.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        words = _known[path] if path in _known else _known.setdefault(path, WordIds(path))
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        keep, ids, shares, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keep, ids, shares, held, sequence
            n = np.array([len(x) // 4 for x in ids], np.int64)
            share = np.array([-1.0 if x is None else x for x in shares])
            rows = []
            for at, pieces in enumerate(pack(n, np.where(share < 0, n - 1, np.ceil(n * np.clip(share, 0, 1))).astype(np.int64), capacity, LEAST_PIECE)):
                offset = 0
                for i, start, length in pieces:
                    rows.append((keep[i], start, length, ids[i][4 * start : 4 * (start + length)], int(n[i]), sequence + at, offset))
                    offset += length
            sequence += len(rows)
            keep, ids, shares, held = [], [], [], 0
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for part in parts(batch, 1, PART_BYTES):
                flat, ends = words.ids(part.column(1))
                for i, a, b, y in zip(part.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), part.column(2).to_pylist(), strict=True):
                    keep.append(i)
                    ids.append(flat[a:b].tobytes() + end)
                    shares.append(y)
                    held += b - a + 1
                    if held >= WINDOW_IDS:
                        yield flush()
        if keep:
            yield flush()
        release_memory()

    share = F.lit(None).cast("double") if loss is None else loss.cast("double")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), share.alias("loss"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
