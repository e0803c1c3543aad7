"""Operator 10: document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes (each value depends on the last 32), computed for all positions by doubling.
Chunk boundaries are normalised: from the least to the usual length a strict mask must match, from there to the greatest
length a loose one. The digests of the chunks, with their lengths, are the fingerprint; an edit changes the chunks near
it only. Two fingerprints are compared by the length of the chunks they share: likeness is its share of the larger one,
containment of one in another its share of the first.

To compare a document with its successor by doc_id, rows are dealt to ranges of (doc_id, text hash), found by binary search
among bounds from a sample, and the first row of each range is copied to the range before it: one shuffle of the texts, no
window over all rows.

Defined results: a null or empty text has an empty fingerprint; two empty fingerprints have likeness 1, an empty one and
another 0; null doc_ids come last; rows that repeat a doc_id follow each other in the order of their text's hash; a table
of one row is its own successor; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abyssal.llm import textkit
from abyssal.llm.common import ship, tidy

_LEAST, _USUAL, _MOST = 32, 96, 384
_GEAR = (textkit.mix(np.arange(257, 513, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
# of the top bits, which depend on all of the last 32 bytes
_STRICT, _LOOSE = np.uint32(0xFF << 24), np.uint32(0x1F << 27)


def gear_hashes(b: np.ndarray) -> np.ndarray:
    """Sum of gear[b[i-j]] << j over the last 32 bytes, by doubling the span."""
    h = _GEAR[b]
    for span in (1, 2, 4, 8, 16):
        new = h.copy()
        if len(h) > span:
            new[span:] += h[:-span] << np.uint32(span)
        h = new
    return h


def chunk_ends(b: np.ndarray) -> list[int]:
    n = len(b)
    if not n:
        return []
    h = gear_hashes(b)
    loose = np.flatnonzero((h & _LOOSE) == 0)
    strict = loose[(h[loose] & _STRICT) == 0].tolist()
    loose = loose.tolist()
    out, at, i, j = [], 0, 0, 0
    n_strict, n_loose = len(strict), len(loose)
    while n - at > _LEAST:
        low, mid, top = at + _LEAST - 1, at + _USUAL - 1, at + _MOST - 1
        while i < n_strict and strict[i] < low:
            i += 1
        if i < n_strict and strict[i] < mid:
            end = strict[i]
        else:
            while j < n_loose and loose[j] < mid:
                j += 1
            end = loose[j] if j < n_loose and loose[j] <= top else top
        if end >= n - 1:
            break
        at = end + 1
        out.append(at)
    out.append(n)
    return out


def chunks(raw: bytes) -> dict[bytes, int]:
    """Digest -> length of a text's distinct chunks."""
    ends = chunk_ends(np.frombuffer(raw, np.uint8))
    out, at = {}, 0
    for end in ends:
        out[hashlib.blake2b(raw[at:end], digest_size=8).digest()] = end - at
        at = end
    return out


def as_text(fp: dict[bytes, int]) -> str:
    """digest:length pairs in the order of the digests."""
    return ",".join(f"{d.hex()}:{n}" for d, n in sorted(fp.items()))


def shared(a: dict[bytes, int], b: dict[bytes, int]) -> int:
    """Length of the chunks that both have."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return sum(n for d, n in small.items() if d in large)


def likeness(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Shared length over the larger length."""
    if not a or not b:
        return float(not a and not b)
    return shared(a, b) / max(sum(a.values()), sum(b.values()))


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """The share of a's length that b has too: 1 where a lies within b, however long b is. An empty a is contained in any b."""
    return shared(a, b) / sum(a.values()) if a else 1.0


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) with fingerprint array<struct<digest: binary, length: int>>, ordered by digest."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"digest": d, "length": n} for d, n in sorted(chunks((t or "").encode()).items())] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint array<struct<digest: binary, length: int>>")


def _range_of(bounds: list[tuple[int, int, int]]) -> Column:
    """How many of the sorted bounds (is null, id, text hash) lie at or below a row (id, t): a binary search."""
    if not bounds:
        return F.lit(0)
    flags, ids, hashes = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in zip(*bounds))  # folded once
    own = F.struct(F.col("id").isNull().cast("bigint"), F.coalesce("id", F.lit(0)), F.col("t"))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        to = at + step - 1
        return F.when((at + step <= len(bounds)) & (F.struct(F.get(flags, to), F.get(ids, to), F.get(hashes, to)) <= own), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def ranged(docs: DataFrame, id_col: str, text_col: str, range_bytes: int = 32 << 20, most_ranges: int = 50_000, sampled: int = 20) -> DataFrame:
    """(b, look, id, text) in partitions by range b of (id, text hash), sorted; look = 1 marks the first row of the next range.

    Ranges have about ``range_bytes`` of text each, ``most_ranges`` at most. Their bounds come from a sample of about ``sampled``
    keys a range, as Spark's own range partitioning has them; results do not depend on it. An id that many rows repeat, or null,
    is cut by its texts' hashes. The first row of each range, and the range before it, are a broadcast table of a row per range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min((size or 0) // range_bytes + 1, most_ranges))
    keys = rows.select("id", "t").sample(min(1.0, sampled * parts / max(n, 1)), seed=10).collect() if parts > 1 else []
    keys = sorted((int(r.id is None), r.id or 0, r.t) for r in keys)
    bounds = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []
    rows = rows.withColumn("b", _range_of(bounds))
    firsts = rows.groupBy("b").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("first"))
    order = W.orderBy("b")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    firsts = firsts.select("b", "first", F.coalesce(F.lag("b").over(order), F.max("b").over(whole)).alias("before"))  # a row per range
    rows = rows.join(F.broadcast(firsts), "b")
    heads = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t"))
    own = F.struct(F.col("b").alias("b"), F.lit(0).alias("look"))
    copy = F.struct(F.col("before").alias("b"), F.lit(1).alias("look"))
    rows = rows.withColumn("to", F.explode(F.when(heads, F.array(own, copy)).otherwise(F.array(own))))
    rows = rows.select("to.b", "to.look", "id", "t", "text")
    return rows.repartitionById(len(bounds) + 1, F.col("b")).sortWithinPartitions("b", "look", F.col("id").asc_nulls_last(), "t").select("b", "look", "id", "text")


def successions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns: each document against its edited text and against the next document.

    After them in_edited and in_next, the share of the document that the edited text and the next document contain.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "in_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
        held: tuple | None = None  # bucket, id, text, fingerprint
        out: list[list] = [[] for _ in names]

        def close(text: str, fp: dict[bytes, int]) -> None:
            _, id_, own, mine = held
            keep = len(own) - len(own) // 2
            edited = (own[:keep] + text[: len(own) // 2]).encode()
            new = chunks(edited)
            for column, value in zip(out, (id_, len(own), hashlib.sha256(edited).hexdigest(), as_text(mine), as_text(new), likeness(mine, new), likeness(mine, fp), containment(mine, new), containment(mine, fp))):
                column.append(value)

        for batch in batches:
            for b, look, id_, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held is None and look:
                    continue  # a second copy: the range is closed
                fp = chunks(text.encode())
                if held is not None:
                    close(text, fp)
                held = None if look else (b, id_, text, fp)
                if len(out[0]) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)
                    out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

    return ranged(docs, id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double")
