"""Operator 13: centroid clustering with Walsh-Hadamard progressive search.

Vectors become integers, floor(scale * x). Both vectors and centroids go through the integer Walsh-Hadamard transform, which
multiplies all squared distances by its length, so sums of squared coefficient differences are exact. Coefficients are taken
in the order of their sign changes, coarse to fine: after a few of them the centroid that is nearest so far is finished, and
its distance is a bound; centroids whose sum is over it are strictly worse and leave. The bound is renewed at each step, and
those that remain are summed over all coefficients, so that ties are seen and the smaller number wins.

Each round is one pass: tasks keep a sum, a count and an inertia per centroid, which Spark adds up, and k times the number of
components comes to the driver, whatever the number of vectors. Sums travel in limbs of 31 bits where components are large, so
that they are exact for every finite input.

Defined results: a vector that is null, has another number of components, or one that is null or not finite is not kept; a
null id hashes as 'null'; ids that repeat are ordered by their vector and are vectors of their own; with fewer kept vectors
than k all of them are starting centroids; a centroid without vectors stays as it is; a distance or inertia beyond a long is
null; no kept vector gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abyssal.llm.common import ship, tidy

#: Components up to this size have distances and partial sums within 64 bits for 64 components.
_SMALL = 1 << 26
_LONG = 1 << 63
_LIMB = 31


def hadamard(x: np.ndarray) -> np.ndarray:
    """The integer Walsh-Hadamard transform of each row; its length is a power of two."""
    n, m = x.shape
    h = 1
    while h < m:
        x = x.reshape(n, m // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        h *= 2
    return x.reshape(n, m)


def coarse_to_fine(m: int) -> np.ndarray:
    """Coefficients by the number of sign changes of their function."""
    rows = hadamard(np.eye(m, dtype=np.int64)).T
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1), kind="stable")


class Search:
    """Nearest centroids of integer vectors, exact, ties to the smaller number."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        width = len(centroids[0])
        self.width, self.m = width, 1 << max(width - 1, 0).bit_length()
        self.order = coarse_to_fine(self.m)
        self.fits = all(abs(x) <= _SMALL for c in centroids for x in c) and self.m <= 64
        if self.fits:
            self.c = self.turned(np.array(centroids, np.int64))

    def turned(self, x: np.ndarray) -> np.ndarray:
        return hadamard(np.pad(x, ((0, 0), (0, self.m - self.width))))[:, self.order]

    def small(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) for rows within _SMALL."""
        t, c = self.turned(x), self.c
        n = len(t)
        first = min(4, self.m)
        sums = np.zeros((n, len(c)), np.int64)
        for i in range(first):
            sums += (t[:, i, None] - c[None, :, i]) ** 2
        every = np.arange(n)
        near = sums.argmin(1)
        bound = sums[every, near] + ((t[:, first:] - c[near, first:]) ** 2).sum(1)
        row, k = np.nonzero(sums <= bound[:, None])
        so_far = sums[row, k]
        at = first
        while at < self.m:
            to = min(2 * at, self.m)
            so_far = so_far + ((t[row, at:to] - c[k, at:to]) ** 2).sum(1)
            if to < self.m:  # finish the nearest so far of each row: a new bound
                begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                best = np.minimum.reduceat(so_far, begins)
                lead = np.flatnonzero(so_far == np.repeat(best, np.diff(np.append(begins, len(row)))))
                whole = so_far[lead] + ((t[row[lead], to:] - c[k[lead], to:]) ** 2).sum(1)
                np.minimum.at(bound, row[lead], whole)
                stay = so_far <= bound[row]
                row, k, so_far = row[stay], k[stay], so_far[stay]
            at = to
        order = np.lexsort((k, so_far, row))
        row, k, so_far = row[order], k[order], so_far[order]
        lead = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
        return k[lead], so_far[lead] // self.m

    def any_size(self, vector: list[int]) -> tuple[int, int]:
        """The same for one vector of any size, in Python's integers."""
        return min((sum((x - y) ** 2 for x, y in zip(vector, c)), k) for k, c in enumerate(self.exact))[::-1]


def integers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """(rows that are kept, their integers, and by place those too large for the fast path, where the integers are 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(pc.equal(pc.list_value_length(column), width).fill_null(False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows, pa.int64())).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    good = np.isfinite(flat).all(1)
    rows, flat = rows[good], flat[good]
    large = np.flatnonzero((np.abs(flat) * scale > _SMALL).any(1)) if len(flat) else np.zeros(0, np.int64)
    exact = {int(i): [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in flat[i].tolist()] for i in large}
    flat[large] = 0
    return rows, np.floor(flat * scale).astype(np.int64), exact


def assigned(search: Search, x: np.ndarray, exact: dict[int, list[int]]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """(numbers, distances) of kept rows; distances are Python's integers where some may be large."""
    if search.fits and not exact:
        return search.small(x)
    if not search.fits:
        exact = {i: exact.get(i) or v for i, v in enumerate(x.tolist())}
        k, d = np.zeros(len(x), np.int64), [0] * len(x)
    else:
        k, d = search.small(x)
        d = d.tolist()
    for i, v in exact.items():
        k[i], d[i] = search.any_size(v)
    return k, d


def limbs(x: int) -> Iterator[tuple[int, int]]:
    """(place, value) with x the sum of value * 2 ** (_LIMB * place), all but the last not negative and under 2 ** _LIMB."""
    at = 0
    while not -_LONG <= x * (1 << 20) < _LONG:
        yield at, x & ((1 << _LIMB) - 1)
        x >>= _LIMB
        at += 1
    yield at, x


def _sums(search: Search, scale: int):
    """Map side of a round: (cluster, place, limb, sum). Places are the components, then the count, then the inertia."""
    width = search.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (width + 2) for _ in search.exact]
        for batch in batches:
            _, x, exact = integers(batch.column(0), width, scale)
            if not len(x):
                continue
            k, d = assigned(search, x, exact)
            for c in np.unique(k).tolist():
                mine = np.flatnonzero(k == c)
                for i, s in enumerate(x[mine].sum(0).tolist()):
                    total[c][i] += s
                total[c][width] += len(mine)
                total[c][width + 1] += sum(int(d[i]) for i in mine.tolist())
            for i, v in exact.items():
                for j, s in enumerate(v):
                    total[int(k[i])][j] += s - int(x[i, j])
        rows = [(c, i, at, s) for c, t in enumerate(total) if t[width] for i, v in enumerate(t) for at, s in limbs(v)]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["cluster", "place", "limb", "s"])

    return run


def _round(vectors: DataFrame, search: Search, scale: int) -> list[list[int]]:
    """For each centroid the sums of its vectors' components, their count and their inertia."""
    out = [[0] * (search.width + 2) for _ in search.exact]
    found = vectors.mapInArrow(tidy(_sums(search, scale)), "cluster int, place int, limb int, s long").groupBy("cluster", "place", "limb").agg(F.sum("s").alias("s"))
    for r in found.collect():  # k times components, and limbs
        out[r["cluster"]][r["place"]] += r["s"] << (_LIMB * r["limb"])
    return out


def starting(vectors: DataFrame, id_col: str, vector_col: str, k: int, width: int, scale: int, seed: str) -> list[list[int]]:
    """The k kept vectors of least sha256(seed:id), as integers."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False)))
    kept = vectors.where(F.coalesce((F.size(v) == width) & whole, F.lit(False)))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    rows = kept.select(hashed.alias("h"), v.cast("array<double>").alias("v")).orderBy("h", "v").limit(k).collect()  # k rows
    return [[int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in r["v"]] for r in rows]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row per kept vector."""
    spark = vectors.sparkSession
    ship(spark)
    kind = dict(vectors.dtypes)[id_col]
    out = f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = starting(vectors, id_col, vector_col, k, width, scale, seed)
    if not centroids:
        return spark.createDataFrame([], out)
    only = vectors.select(vector_col)
    for _ in range(rounds):
        sums = _round(only, Search(centroids), scale)
        centroids = [[s // t[width] for s in t[:width]] if t[width] else c for c, t in zip(centroids, sums)]
    search = Search(centroids)
    inertia = [t[width + 1] for t in _round(only, search, scale)]
    long = lambda x: x if x < _LONG else None
    total, each = long(sum(inertia)), [long(x) for x in inertia]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x, exact = integers(batch.column(1), width, scale)
            if len(rows):
                n, d = assigned(search, x, exact)
                at = pa.array(n, pa.int64())
                d = pa.array([long(int(i)) for i in d] if exact or not search.fits else d, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n.astype(np.int32)), d, pa.array(each, pa.int64()).take(at), pa.array([total] * len(rows), pa.int64()), pa.array(digest).take(at)], names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.select(id_col, vector_col).mapInArrow(tidy(run), out)


def _oracle(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """The same in DuckDB, round by round."""
    apart = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"
    parts = [
        f"v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {width})",
        f"c0 as materialized (select row_number() over (order by h) - 1 as c, v from (select sha256('2:' || cast(vec_id as varchar)) as h, v from v order by h limit {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} as materialized (select vec_id, v, min(s) as s from (select a.vec_id, a.v, struct_pack(d := cast({apart} as bigint), c := b.c) as s from v a, c{i} b) group by vec_id, v)")
        if i < rounds:
            parts.append(f"s{i} as materialized (select c, i, sum(x) as s, count(*) as n from (select s.c as c, unnest(range({width})) as i, unnest(v) as x from d{i}) group by c, i)")
            parts.append(f"n{i} as materialized (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from s{i} group by c)")
            parts.append(f"c{i + 1} as materialized (select c{i}.c, coalesce(n{i}.v, c{i}.v) as v from c{i} left join n{i} using (c))")
    last = f"select d.vec_id, cast(d.s.c as int) as cluster, d.s.d as distance, cast(sum(d.s.d) over (partition by d.s.c) as bigint) as cluster_inertia, cast(sum(d.s.d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256 from d{rounds} d join c{rounds} c on c.c = d.s.c"
    return "with " + ",\n".join(parts) + "\n" + last


ORACLE = _oracle()
