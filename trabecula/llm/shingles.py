"""Hashes of words and of runs of words, many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import words

_MUL, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_hashes(text: Column) -> Column:
    """array<long>: xxhash64 of each word; null and empty texts have none."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a batch in a row, and where each text begins (one more for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values[offsets[0] : offsets[-1]].to_numpy(zero_copy_only=False).view(np.uint64)
    return values, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "hashes", most: int = 400_000):
    """The batch in pieces of about `most` hashes at most, at least a row each, so that work arrays stay small."""
    ends = np.cumsum(np.diff(flat(batch.column(column))[1])) if len(batch) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of hashes[i : i + n] for each i; positions across two texts of a batch are for the caller to leave out."""
    m = max(0, len(hashes) - n + 1)
    acc = np.full(m, seed, np.uint64)
    for j in range(n):
        acc = acc * _MUL + hashes[j : j + m]
        if j % 4 == 3:
            acc = acc ^ (acc >> np.uint64(29))
    return mixed(acc)
