"""Encoders of texts as vectors: a protocol, and a deterministic one that hashes words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """One unit row per text."""


class HashingEncoder:
    """Signed hashed word counts at unit length; an empty text is all zero."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for r, t in enumerate(texts):
            words = np.array((t or "").lower().split(), object)
            if len(words):
                h = pd.util.hash_array(words, categorize=False)
                np.add.at(out[r], (h % np.uint64(self.dim)).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed(backlog: DataFrame, encoder: Encoder, batch: int = 256) -> DataFrame:
    """(id, embedding) for (id, text); texts are encoded in batches sorted by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = [t or "" for t in whole.column(1).to_pylist()]
            out = np.zeros((len(texts), encoder.dim), np.float32)
            order = np.argsort([len(t) for t in texts], kind="stable")
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                out[at] = encoder.encode([texts[i] for i in at])
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array(list(out), pa.list_(pa.float32()))], names=["id", "embedding"])

    return backlog.select("id", "text").mapInArrow(run, "id long, embedding array<float>")
