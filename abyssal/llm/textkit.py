"""Vectorised text primitives over Arrow string buffers (numpy only, used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step looks at; a longer single text is a step of its own.
STEP_BYTES = 1 << 18

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE[_SEP] = 0
_BASE = U64(0xD6E8FEB86659FD93)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows in ``offsets`` and the number of words of each row."""
    base = int(offsets[0])
    b = data[base : int(offsets[-1])]
    rows = len(offsets) - 1
    if not len(b):
        return np.zeros(0, U64), np.zeros(rows, np.int64)
    b = _LOWER[b] if lower else b
    inside = ~_SEP[b]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    doc_starts = offsets[:-1] - base
    firsts = doc_starts[doc_starts < len(b)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(rows, np.int64)
    place = np.zeros(len(b), np.int64)
    place[starts] = starts
    place = np.arange(len(b)) - np.maximum.accumulate(place)
    place[~inside] = 0
    power = np.empty(int(place.max()) + 1, U64)
    power[0] = 1
    power[1:] = _BASE
    power = np.multiply.accumulate(power)
    hashed = mix(np.add.reduceat(_BYTE[b] * power[place], starts))
    ends = np.searchsorted(starts, offsets[1:] - base, "left")
    counts = np.diff(np.concatenate([[0], ends]))
    return hashed, counts


_STEP_MULT = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(hashed: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row in text order, and their number per row.

    A row with 1 to k-1 words has one shingle, its whole word sequence; a row without words has none.
    """
    rows = len(counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    m = len(hashed)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(per.sum()), U64)
    at = np.cumsum(per) - per
    if m >= k:
        full = np.zeros(m - k + 1, U64)
        for j in range(k):
            full += hashed[j : m - k + 1 + j] * _STEP_MULT[j % 8] * U64(2 * (j // 8) + 1)
        full = mix(full)
        keep = np.repeat(counts >= k, counts)[: m - k + 1]
        left = np.repeat(ends, counts)[: m - k + 1] - np.arange(m - k + 1)
        picked = full[keep & (left >= k)]
        place = np.repeat(np.where(counts >= k, per, 0) > 0, per)
        out[place] = picked
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        h = U64(int(counts[r]))
        for j, w in enumerate(hashed[starts[r] : ends[r]].tolist()):
            h = U64((int(h) * 0x9E3779B97F4A7C15 + w * int(_STEP_MULT[j]) + j + 1) & 0xFFFFFFFFFFFFFFFF)
        out[at[r]] = mix(np.array([h], U64))[0]
    assert rows == len(per)
    return out, per
