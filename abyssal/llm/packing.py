"""Packed shuffles: numbers travel as a few rows of bytes, dealt to buckets, and are grouped in numpy on the other side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(x)]]))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket from the upper half of an unsigned 64-bit hash."""
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def dealt(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row (bucket, bytes of each column) for each bucket that occurs. Columns have a row per entry."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    starts, sizes = runs(bucket)
    packed = [pa.array([c[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist())], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), *packed], names=["bucket", *names])


def gathered(batches: Iterator[pa.RecordBatch], kinds: list) -> list[np.ndarray]:
    """The columns of all packed rows of a task, one after another; a kind is a dtype, or (dtype, width) for rows of a matrix."""
    parts: list[list[bytes]] = [[] for _ in kinds]
    for batch in batches:
        for i, p in enumerate(parts):
            p += batch.column(i + 1).to_pylist()
    out = []
    for p, kind in zip(parts, kinds):
        dtype, width = kind if isinstance(kind, tuple) else (kind, 0)
        flat = np.frombuffer(b"".join(p), dtype)
        p.clear()
        out.append(flat.reshape(-1, width) if width else flat)
    return out
