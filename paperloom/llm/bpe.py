"""Byte-level BPE over a whole corpus in padded numpy matrices.

The vocabulary file (a public ``.tiktoken`` rank list; its path is a parameter) is read
once by the driver and broadcast: it is fixed at some 50,000 entries. Each Arrow batch is
cut into pieces by the tokenizer's published pattern; the batch's distinct pieces not yet
known to the worker are sorted into buckets by length, one padded int32 matrix per
bucket. In each round every row of a matrix finds its leftmost pair of minimum rank
through an open-addressing hash table and merges it, and the matrix is compacted by one
column; rows without a mergeable pair leave it. Pieces over ``LONG_PIECE`` bytes, where
that would be quadratic, take a heap over a linked list with the same merge order.

No shuffle and one pass over the text; the work is spread over more tasks only where the
scan has too few splits.

Defined results: a null or empty text has an empty list; strings that look like special
tokens are plain text; each input row gives one row.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The tokenizer's published pre-tokenization pattern (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LONG_PIECE = 256
CACHE_PIECES = 400_000
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash from a pair of token ids to the id, which is also the rank, of their merge."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 20) | right)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        todo_k, todo_v = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(todo_k)
        while len(todo_k):  # every pending key tries its slot; one winner per free slot, the rest probe on
            free = self.keys[slot] == -1
            first = np.zeros(len(slot), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            won = free & first
            self.keys[slot[won]], self.values[slot[won]] = todo_k[won], todo_v[won]
            todo_k, todo_v, slot = todo_k[~won], todo_v[~won], slot[~won]
            taken = self.keys[slot] != -1
            slot = np.where(taken, (slot + 1) & (size - 1), slot)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge's rank for each pair, NONE where there is none."""
        keys = (left.astype(np.int64) << 20) | right
        flat = keys.ravel()
        slot = self._slot(flat)
        out = np.full(flat.shape, NONE, np.int32)
        todo = np.arange(len(flat))
        while len(todo):
            at = slot[todo]
            held = self.keys[at]
            hit = held == flat[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (held != -1)]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return out.reshape(keys.shape)


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.pattern = regex.compile(PATTERN)
        self.table = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, np.ndarray] = {}

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Token ids of each piece, by length bucket."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) > LONG_PIECE:
                out[i] = self._encode_long(b)
            else:
                buckets.setdefault(max(1, len(b) - 1).bit_length(), []).append(i)
        for rows in buckets.values():
            width = max(len(raw[i]) for i in rows)
            matrix = np.full((len(rows), width), -1, np.int32)
            for r, i in enumerate(rows):
                matrix[r, : len(raw[i])] = self.byte_ids[np.frombuffer(raw[i], np.uint8)]
            for i, ids in zip(rows, self._merge_rounds(matrix), strict=True):
                out[i] = ids
        return out

    def _merge_rounds(self, matrix: np.ndarray) -> list[np.ndarray]:
        done: list[np.ndarray | None] = [None] * len(matrix)
        row = np.arange(len(matrix))

        def flush(rows: np.ndarray, of: np.ndarray) -> None:
            for r, ids in zip(rows, of, strict=True):
                done[r] = ids[ids >= 0]

        ranks = self._ranks(matrix)
        while len(row):
            if matrix.shape[1] < 2:
                flush(row, matrix)
                break
            at = ranks.argmin(axis=1)  # the leftmost of equal minima
            best = ranks[np.arange(len(row)), at]
            live = best != NONE
            if not live.all():
                flush(row[~live], matrix[~live])
                row, matrix, ranks, at, best = row[live], matrix[live], ranks[live], at[live], best[live]
                if not len(row):
                    break
            n = np.arange(len(row))
            matrix[n, at] = best
            keep = np.ones(matrix.shape, bool)
            keep[n, at + 1] = False
            matrix = matrix[keep].reshape(len(row), -1)
            if matrix.shape[1] < 2:
                continue
            # only the pairs beside the merge change; the others move with their columns
            gone = np.ones(ranks.shape, bool)
            gone[n, at] = False
            ranks = ranks[gone].reshape(len(row), -1)
            width = ranks.shape[1]
            for shift in (-1, 0):
                col = at + shift
                ok = (col >= 0) & (col < width)
                left, right = matrix[n[ok], col[ok]], matrix[n[ok], col[ok] + 1]
                fresh = np.full(len(left), NONE, np.int32)
                real = right >= 0
                fresh[real] = self.table.lookup(left[real], right[real])
                ranks[n[ok], col[ok]] = fresh
        return done

    def _ranks(self, matrix: np.ndarray) -> np.ndarray:
        left, right = matrix[:, :-1], matrix[:, 1:]
        out = np.full(left.shape, NONE, np.int32)
        real = right >= 0
        out[real] = self.table.lookup(left[real], right[real])
        return out

    def _encode_long(self, data: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        start = self.table.lookup(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(start) if r != NONE]
        heapq.heapify(heap)
        alive = [True] * n

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                r = int(self.table.lookup(np.array([ids[i]], np.int32), np.array([ids[j]], np.int32))[0])
                if r != NONE:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j] = rank, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return np.array([t for t, a in zip(ids, alive, strict=True) if a], np.int32)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        fresh = list({p for pieces in cut for p in pieces} - self.known.keys())
        if len(self.known) + len(fresh) > CACHE_PIECES:
            self.known.clear()
            fresh = list({p for pieces in cut for p in pieces})
        self.known.update(zip(fresh, self.encode_pieces(fresh), strict=True))
        empty = np.empty(0, np.int32)
        return [np.concatenate([self.known[p] for p in pieces]) if pieces else empty for pieces in cut]


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank list of a ``.tiktoken`` file."""
    out = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def encode_corpus(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, batch: int = 2000
) -> DataFrame:
    """(id_col, ids) of every row."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairEncoder(ranks.value)
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                ids = encoder.encode_batch(part.column(1).to_pylist())
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return spread(documents.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")
