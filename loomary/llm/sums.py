"""Distributed sums of long integer vectors: counters over a fixed set of words, buckets or bins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers in one row of a partial sum.
CHUNK = 1 << 14

_SCHEMA = "part int, width int, counts binary"


def _packed(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Partial sums in the narrowest integers that hold them."""
    kinds = [next(k for k in (np.uint8, np.int16, np.int32, np.int64) if a.min() >= np.iinfo(k).min and a.max() <= np.iinfo(k).max) for a in parts.values()]
    data = [a.astype(k).tobytes() for a, k in zip(parts.values(), kinds, strict=True)]
    return pa.record_batch([pa.array(list(parts), pa.int32()), pa.array([np.dtype(k).itemsize for k in kinds], pa.int32()), pa.array(data, pa.binary())], names=["part", "width", "counts"])


def _unpacked(width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.int16, 4: np.int32, 8: np.int64}[width]).astype(np.int64)


def _rows(total: np.ndarray) -> pa.RecordBatch:
    return _packed({i // CHUNK: total[i : i + CHUNK] for i in range(0, len(total), CHUNK) if total[i : i + CHUNK].any()})


def summed(df: DataFrame, count: Callable[[pa.RecordBatch, np.ndarray], None], length: int) -> np.ndarray:
    """The sum over all batches of what ``count(batch, total)`` adds to a vector of ``length`` numbers.

    Each task sends one vector, in chunks; chunks are added up before anything comes to the driver,
    which receives ``length`` numbers whatever the size of ``df``.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for b in batches:
            count(b, total)
        yield _rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, w, x in zip(*[b.column(c).to_pylist() for c in ("part", "width", "counts")], strict=True):
                a = _unpacked(w, x)
                sums[i] = sums[i] + a if i in sums else a
        yield _packed(sums)

    rows = df.mapInArrow(partial, _SCHEMA).repartition("part").mapInArrow(add, _SCHEMA).toArrow()
    out = np.zeros(length, np.int64)
    for i, w, x in zip(*[rows[c].to_pylist() for c in ("part", "width", "counts")], strict=True):
        a = _unpacked(w, x)
        out[i * CHUNK : i * CHUNK + len(a)] = a
    return out
