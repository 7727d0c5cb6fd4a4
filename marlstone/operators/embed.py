"""Embedders, and the vectors of windows that have none yet."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T


class Embedder(Protocol):
    id: str
    window_chars: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Hashed:
    """Unit vectors from 32-bit FNV-1a hashes of the text and the place: repeatable, offline, without meaning."""

    window_chars = 1024

    def __init__(self, dim: int = 32):
        self.dim, self.id = dim, f"fake:hash:{dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self.dim))
        tails = [np.frombuffer(f"#{k}".encode("utf-16-le"), np.uint16) for k in range(self.dim)]
        for r, t in enumerate(texts):
            h = fnv(np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16))
            out[r] = [fnv(tail, h) for tail in tails]
        out = (out / 0xFFFFFFFF * 2 - 1).astype(np.float32)
        size = np.sqrt((out.astype(np.float64) ** 2).sum(1, keepdims=True))
        return (out / np.where(size > 0, size, 1)).astype(np.float32)


def fnv(units, h: int = 2166136261) -> int:
    """32-bit FNV-1a over 16-bit units."""
    for u in units.tolist():
        h = (h ^ u) * 16777619 & 0xFFFFFFFF
    return h


EMBEDDERS: dict = {"fake": Hashed}


def embedder(name: str = "fake", **how) -> Embedder:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name](**how)


def unit_vectors(batches):
    """Little-endian 32-bit floats in a binary column, as unit vectors."""
    for b in batches:
        out = []
        for x in b.column(1).to_pylist():
            v = None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").astype(np.float64)
            n = 0.0 if v is None else float(np.sqrt(v @ v))
            out.append(None if v is None else (v / n if n > 0 else v).astype(np.float32).tolist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], ["id", "vec"])


def decoded(df: DataFrame) -> DataFrame:
    """id and vec of ``df`` (id, data); null where the bytes are no whole floats."""
    return df.select("id", "data").mapInArrow(unit_vectors, "id string, vec array<float>")


def backfill(chunks: DataFrame, have: DataFrame, model: Embedder, again: bool = False) -> DataFrame:
    """id, seq, ord, model and vec for the windows of ``chunks`` (id, seq, heading, text) that ``have`` (id, seq, model) has no
    vector for by this model; with ``again``, for all. Partitions stay as they are, and a batch is embedded at once."""
    todo = chunks if again else chunks.join(have.where(F.col("model") == model.id).select("id", "seq").distinct(), ["id", "seq"], "left_anti")
    w = todo.select("id", "seq", F.posexplode(T.windows(F.col("text"), F.col("heading"), model.window_chars)).alias("ord", "window"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                v = model.embed(b.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([model.id] * b.num_rows), pa.array(list(v), pa.list_(pa.float32()))], ["id", "seq", "ord", "model", "vec"])

    return w.mapInArrow(run, "id string, seq int, ord int, model string, vec array<float>")
