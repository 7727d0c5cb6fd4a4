"""Counts of codes below a fixed bound, over all rows: arrays of fixed size, merged in chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm._shared import tidy


def tally(df: DataFrame, codes, length: int, final=None) -> np.ndarray:
    """``codes`` maps an Arrow batch to arrays of integers from 0 to length - 1; their counts.

    A task sends its counts in chunks that meet by number, so what is sent
    follows the rows of a task, up to the array itself, and neither a task nor
    the driver holds more than that. ``final``: maps whole counts to bytes, 0 to
    0, where a chunk is summed; then the driver gets and returns a byte for each.
    """
    chunk = max(4096, length // 256)
    large = length > 1 << 22  # no second array of full length, and half the width

    def count(batches):
        total = np.zeros(length, np.uint32 if large else np.int64)
        for b in batches:
            for at in [np.concatenate(some).astype(np.int64) for some in [[c for c in codes(b) if len(c)]] if some]:
                if large:
                    np.add.at(total, at, np.uint32(1))
                elif 16 * len(at) < length:  # no second array of full length for a few codes
                    at, n = np.unique(at, return_counts=True)
                    total[at] += n
                else:
                    total += np.bincount(at, minlength=length)
        for c in range(0, length, chunk):
            yield from send(c, total[c : c + chunk])

    def send(c, counts, final=None):
        """Every count of a chunk, or the places and values of those over zero where that is less; each in as few bytes as hold it."""
        at = np.flatnonzero(counts)
        if len(at):
            kind = np.min_scalar_type(int(counts.max()))
            few = len(at) * (place.itemsize + kind.itemsize) < len(counts) * kind.itemsize
            at, counts = (at.astype(place), counts[at]) if few else (at[:0], counts)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([at.tobytes()], pa.binary()), pa.array([(final(counts) if final else counts.astype(kind)).tobytes()], pa.binary())], ["chunk", "at", "n"])

    place = np.dtype(np.uint16 if chunk <= 1 << 16 else np.uint32)

    def read(c, at, n, out):
        """Add a chunk that was sent to ``out``."""
        at = np.frombuffer(at, place)
        where = at if len(at) else slice(0, min(chunk, length - c))
        out[where] += np.frombuffer(n, f"u{len(n) // (len(at) or where.stop)}").astype(out.dtype)

    def add(batches):
        sums: dict = {}
        for b in batches:
            for c, at, n in zip(*(x.to_pylist() for x in b.columns)):
                read(c, at, n, sums.setdefault(c, np.zeros(min(chunk, length - c), np.int64)))
        for c, counts in sums.items():
            yield from send(c, counts, final)

    out = np.zeros(length, np.uint8 if final else np.int64)
    shape = "chunk long, at binary, n binary"
    with tidy(df.sparkSession):
        for r in df.mapInArrow(count, shape).repartition("chunk").mapInArrow(add, shape).collect():
            read(r["chunk"], r["at"], r["n"], out[r["chunk"] : r["chunk"] + chunk])
    return out
