"""Natural neighbours, exact: Sibson's weights from the cell that a target would take of its neighbours' cells.

The target's Voronoi cell among the samples is cut from a large square by bisectors. A vertex of it is a circumcentre; the cell
is final when no sample lies nearer to any vertex than the target does, that is when these circles are empty. The nearest
samples give a first cell; where its circles reach beyond them, the leaves that they meet are fetched and the cell is cut
again, until no circle meets a leaf that was not looked at. The weight of a sample is the part of the final cell that is nearer
to it than to any other neighbour. A cell that is never closed has its target outside the convex hull: NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abyssal.operators.nearest import Leaves, flat, unpack
from abyssal.session import written

#: The square's half side, in diagonals of all that is there. Targets nearer to the hull's edge than its inverse may count as outside.
_WIDE = 1e5
_SQUARE = np.array([[-1.0, -1.0], [1.0, -1.0], [1.0, 1.0], [-1.0, 1.0]])
_GROUP = 500
_STEP = 3_000_000


def clip(poly: np.ndarray, count: np.ndarray, normal: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex polygons (b, m, 2), the first ``count`` vertices of each, cut to p . normal <= offset."""
    b, m = poly.shape[:2]
    side = (poly * normal[:, None]).sum(2) - offset[:, None]
    idx = np.arange(m)
    valid = idx < count[:, None]
    after = np.where(idx + 1 < count[:, None], idx + 1, 0)
    side2 = np.take_along_axis(side, after, 1)
    poly2 = np.take_along_axis(poly, after[:, :, None], 1)
    inside, inside2 = side <= 0, side2 <= 0
    cross = valid & (inside != inside2)
    with np.errstate(divide="ignore", invalid="ignore"):
        met = poly + np.where(cross, side / (side - side2), 0.0)[:, :, None] * (poly2 - poly)
    keep = np.stack([valid & inside, cross], 2).reshape(b, 2 * m)
    every = np.stack([poly, met], 2).reshape(b, 2 * m, 2)
    n = keep.sum(1)
    out = np.zeros((b, max(int(n.max()) if b else 0, 1), 2))
    row, at = np.nonzero(keep)
    out[row, (np.cumsum(keep, 1) - 1)[row, at]] = every[row, at]
    return out, n


def _beyond(poly: np.ndarray, count: np.ndarray, s: np.ndarray) -> np.ndarray:
    """(b, c): how far, in squared distance, each sample lies within the widest-met circle of the cell; relative to its scale."""
    reach = 2 * np.einsum("bmk,bck->bmc", poly, s) - (s**2).sum(2)[:, None]
    reach[np.arange(poly.shape[1]) >= count[:, None]] = -np.inf
    size = np.sqrt((poly**2).sum(2).max(1))[:, None] * np.sqrt((s**2).sum(2)) + (s**2).sum(2)
    return reach.max(1) / np.maximum(size, 1e-300)


def cells(s: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of targets at the origin among samples s (b, c, 2), cut from squares of half sides ``half``, and their numbers of vertices.

    Squares grow from the distance of the nearest sample, as long as a cell reaches its square: so vertices are exact to the
    cell's own size.
    """
    poly, count = np.zeros((len(s), 4, 2)), np.zeros(len(s), np.int64)
    going = np.arange(len(s))
    size = np.minimum(16 * np.sqrt((s**2).sum(2).min(1)), half) if s.shape[1] else half.copy()
    while len(going):
        new, n = _cells_in(s[going], size[going])
        if new.shape[1] > poly.shape[1]:
            poly = np.concatenate([poly, np.zeros((len(poly), new.shape[1] - poly.shape[1], 2))], 1)
        poly[going] = 0
        poly[going, : new.shape[1]], count[going] = new, n
        reached = np.where(np.arange(new.shape[1])[None, :, None] < n[:, None, None], np.abs(new), 0).max((1, 2)) >= 0.999 * size[going]
        going = going[reached & (size[going] < half[going])]
        size[going] = np.minimum(64 * size[going], half[going])
    return poly, count


def _cells_in(s: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    poly, count = _SQUARE[None] * half[:, None, None], np.full(len(s), 4)
    used = np.zeros(s.shape[:2], bool)
    going = np.arange(len(s)) if s.shape[1] else np.zeros(0, np.int64)
    while len(going):
        reach = np.where(used[going], -np.inf, _beyond(poly[going], count[going], s[going]))
        j = reach.argmax(1)
        cut = reach[np.arange(len(going)), j] > 1e-13
        going, j = going[cut], j[cut]
        if not len(going):
            break
        used[going, j] = True
        normal = s[going, j]
        new, n = clip(poly[going], count[going], normal, (normal**2).sum(1) / 2)
        if new.shape[1] > poly.shape[1]:
            poly = np.concatenate([poly, np.zeros((len(poly), new.shape[1] - poly.shape[1], 2))], 1)
        poly[going, : new.shape[1]], count[going] = new, n
    return poly, count


def _area(poly: np.ndarray, count: np.ndarray) -> np.ndarray:
    idx = np.arange(poly.shape[1])
    after = np.take_along_axis(poly, np.where(idx + 1 < count[:, None], idx + 1, 0)[:, :, None], 1)
    twice = np.where(idx < count[:, None], poly[:, :, 0] * after[:, :, 1] - after[:, :, 0] * poly[:, :, 1], 0.0).sum(1)
    return np.where(count >= 3, twice / 2, 0.0)


def values(poly: np.ndarray, count: np.ndarray, s: np.ndarray, v: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Sibson's mean of v (b, c) for final cells; NaN where a cell reaches the square. s comes by distance, then sid."""
    out = np.full(len(s), np.nan)
    closed = np.where(np.arange(poly.shape[1])[None, :, None] < count[:, None, None], np.abs(poly), 0).max((1, 2)) < 0.999 * half
    rows = np.flatnonzero(closed & (count >= 3))
    if not len(rows):
        return out
    poly, count, s, v = poly[rows], count[rows], s[rows], v[rows]
    touch = _beyond(poly, count, s) >= -1e-9
    k = int(touch.sum(1).max())
    order = np.argsort(~touch, axis=1, kind="stable")[:, :k]
    touch = np.take_along_axis(touch, order, 1)
    s, v = np.take_along_axis(s, order[:, :, None], 1), np.take_along_axis(v, order, 1)
    for i in range(1, k):  # of samples at one place the first
        touch[:, i] &= ~((s[:, :i] == s[:, i : i + 1]).all(2) & touch[:, :i]).any(1)
    # the cell once more, from a square of its own size: vertices as exact as it is small
    around = 1.5 * np.where(np.arange(poly.shape[1])[None, :, None] < count[:, None, None], np.abs(poly), 0).max((1, 2))
    poly, count = _SQUARE[None] * around[:, None, None], np.full(len(rows), 4)
    for j in range(k):
        normal = np.where(touch[:, j, None], s[:, j], 0.0)
        poly, count = clip(poly, count, normal, (normal**2).sum(1) / 2)
    b, m = poly.shape[:2]
    part = np.repeat(poly, k, 0).reshape(b * k, m, 2)
    n = np.where(touch, count[:, None], 0).reshape(-1)
    own = s.reshape(-1, 2)
    for j in range(k):
        other = np.repeat(s[:, j], k, 0)
        normal, offset = other - own, ((other**2).sum(1) - (own**2).sum(1)) / 2
        off = ~np.repeat(touch[:, j], k)
        normal[off], offset[off] = 0.0, 0.0
        part, n = clip(part, n, normal, offset)
    w = _area(part, n).reshape(b, k)
    out[rows] = (w * v).sum(1) / w.sum(1)
    return out


def _meets(at: np.ndarray, poly: np.ndarray, count: np.ndarray, box: np.ndarray) -> np.ndarray:
    """(b, leaves): whether a circle of the cell meets the leaf's box."""
    out = np.zeros((len(at), len(box)), bool)
    step = max(1, _STEP // max(poly.shape[1] * len(box), 1))
    for a in range(0, len(at), step):
        v = poly[a : a + step]
        p = v + at[a : a + step, None]
        gap = lambda i: np.maximum(np.maximum(box[:, 2 * i] - p[:, :, None, i], p[:, :, None, i] - box[:, 2 * i + 1]), 0)  # noqa: E731, B023
        hit = gap(0) ** 2 + gap(1) ** 2 < (v**2).sum(2)[:, :, None] * (1 - 1e-13)
        hit &= (np.arange(v.shape[1]) < count[a : a + step, None])[:, :, None]
        out[a : a + step] = hit.any(1)
    return out


def _first(leaves: Leaves, diagonal: float, middle: np.ndarray):
    """(id, x, y, no, leaf, near) -> (id, x, y, no, leaf, v, need): need lists the leaves to look at, NULL where v is final."""
    total, ids, box = leaves.n, leaves.ids, leaves.box

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, d2, places, v = flat(batch.column(5))
            b = batch.num_rows
            value = np.full(b, np.nan)
            need: list = [None] * b
            starts = np.cumsum(sizes) - sizes
            xy = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)], 1)
            for m in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == m)
                e = starts[rows][:, None] + np.arange(m)
                here = d2[e[:, 0]] == 0
                value[rows[here]] = v[e[here, 0]]
                rows, e = rows[~here], e[~here]
                if not len(rows):
                    continue
                at = xy[rows]
                s = places[e] - at[:, None]
                half = _WIDE * (diagonal + np.hypot(*(at - middle).T))
                poly, count = cells(s, half)
                radius = np.sqrt(np.where(np.arange(poly.shape[1]) < count[:, None], (poly**2).sum(2), 0).max(1))
                done = (2 * radius < np.sqrt(d2[e[:, -1]]) * (1 - 1e-12)) | (m >= total)
                left = np.flatnonzero(~done)
                met = _meets(at[left], poly[left], count[left], box)
                done[left[~met.any(1)]] = True
                value[rows[done]] = values(poly[done], count[done], s[done], v[e[done]], half[done])
                for i, hit in zip(rows[left].tolist(), met):
                    need[i] = ids[hit].tolist() or None
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(value, from_pandas=True), pa.array(need, pa.list_(pa.int64()))], names=["id", "x", "y", "no", "leaf", "v", "need"])

    return run


def by_distance(d2: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Means of v (b, m) by inverse squared distance; a sample at the very place decides alone."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (v / d2).sum(1) / (1 / d2).sum(1)
    return np.where(d2[:, 0] == 0, v[:, 0], out)


def _again(leaves: Leaves, diagonal: float, middle: np.ndarray):
    """Open targets of a group and the leaves that any of them needs -> the columns of ``_first``."""
    ids, box = leaves.ids, leaves.box

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        looked = np.unique(right["of"].to_numpy())
        _, places, v = unpack([x.as_py() for x in right["data"]])
        at = np.stack([left["x"].to_numpy(), left["y"].to_numpy()], 1)
        value, need = np.full(len(at), np.nan), [None] * len(at)
        step = max(1, _STEP // (16 * max(len(places), 1)))
        for a in range(0, len(at), step):
            q = at[a : a + step]
            s = places[None] - q[:, None]
            half = _WIDE * (diagonal + np.hypot(*(q - middle).T))
            poly, count = cells(s, half)
            met = _meets(q, poly, count, box)
            new = (met & ~np.isin(ids, looked)[None]).any(1)
            done = np.flatnonzero(~new)
            value[a + done] = values(poly[done], count[done], s[done], np.broadcast_to(v, (len(done), len(v))), half[done])
            for i in np.flatnonzero(new).tolist():
                need[a + i] = np.union1d(looked, ids[met[i]]).tolist()
        return pa.table([*[left[c] for c in ("id", "x", "y", "no", "leaf")], pa.array(value, from_pandas=True), pa.array(need, pa.list_(pa.int64()))], names=["id", "x", "y", "no", "leaf", "v", "need"])

    return run


def natural_of(near: DataFrame, leaves: Leaves, kind: str) -> DataFrame:
    """(id, x, y, v) from the rows of ``nearest_of``: v by natural neighbours."""
    out = f"id {kind}, x double, y double, no long, leaf long, v double, need array<long>"
    names = ["id", "x", "y", "v"]
    low, high = leaves.box[:, [0, 2]].min(0), leaves.box[:, [1, 3]].max(0)
    diagonal, middle = max(float(np.hypot(*(high - low))), 1e-300), (low + high) / 2
    step = written(near.select("id", "x", "y", "no", "leaf", "near").mapInArrow(_first(leaves, diagonal, middle), out), "natural")
    done = None
    while True:
        part = step.where("need is null").select(*names)
        done = part if done is None else done.unionByName(part)
        open_ = step.where("need is not null")
        if open_.isEmpty():
            return done
        size = open_.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        groups = open_.join(size, "leaf").withColumn("part", F.pmod(F.xxhash64("no"), F.ceil(F.col("n") / _GROUP))).drop("n")
        given = groups.select(F.col("leaf").alias("l"), F.col("part").alias("p"), F.explode("need").alias("of")).distinct().join(leaves.packed.select(F.col("leaf").alias("of"), "data"), "of")
        step = written(groups.groupBy("leaf", "part").cogroup(given.groupBy("l", "p")).applyInArrow(_again(leaves, diagonal, middle), out), "natural_more")
