"""Samples in packed leaves, and the nearest of them, exactly, wherever they are dense.

Leaves are the boxes of a k-d tree whose cuts come from a bounded sample of the places, so that a dense area has small leaves;
every sample is in one leaf, which travels as a row of packed arrays. Samples at one place beyond the n of least sid cannot
be among n nearest and leave first, so a leaf is bounded however many share a place. Targets meet the leaves around them in
numpy, in groups bounded by ``_GROUP`` targets. A target is settled when its n-th neighbour is no farther than all leaves that
were left out; else that distance bounds what it needs, and one more meeting settles it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abyssal.session import ship_code, written

#: Places that the cuts are made from, and leaves at most: what the driver holds.
_PLACES, _LEAVES = 100_000, 16_384
#: Targets of a group.
_GROUP = 20_000
#: Distances that one step holds.
_STEP = 2_000_000


class Tree:
    """Cuts of a k-d tree; children that are negative are leaves."""

    def __init__(self, xy: np.ndarray, per: float):
        self.axis, self.value, self.child = [], [], []
        self.leaves = 0
        open_ = [(np.arange(len(xy)), None, 0)]
        while open_:
            rows, parent, side = open_.pop()
            p = xy[rows]
            cut = None
            if len(rows) > per:
                for axis in np.argsort(np.ptp(p, axis=0))[::-1].tolist():
                    at = float(np.median(p[:, axis]))
                    left = p[:, axis] < at
                    if not left.any():  # more than half lie at the lowest
                        at = float(np.nextafter(at, np.inf))
                        left = p[:, axis] < at
                    if 0 < left.sum() < len(rows):
                        cut = (axis, at, left)
                        break
            if cut is None:
                number = -1 - self.leaves
                self.leaves += 1
            else:
                number = len(self.axis)
                self.axis.append(cut[0])
                self.value.append(cut[1])
                self.child.append([0, 0])
                open_ += [(rows[cut[2]], number, 0), (rows[~cut[2]], number, 1)]
            if parent is not None:
                self.child[parent][side] = number
        self.axis, self.value = np.array(self.axis, np.int64), np.array(self.value, float)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)

    def of(self, xy: np.ndarray) -> np.ndarray:
        """The leaf of each place; -1 where a coordinate is not finite."""
        good = np.isfinite(xy).all(1)
        if not len(self.axis):
            return np.where(good, 0, -1)
        at = np.zeros(len(xy), np.int64)
        going = np.arange(len(xy))
        while len(going):
            node = at[going]
            at[going] = self.child[node, (xy[going, self.axis[node]] >= self.value[node]).astype(np.int64)]
            going = going[at[going] >= 0]
        return np.where(good, -1 - at, -1)


def tree_of(rows: DataFrame, n: int, per: float) -> Tree:
    """The tree of n rows (x, y), a written table, with about ``per`` of them in a leaf; its cuts come from a bounded sample."""
    share = min(1.0, _PLACES / max(n, 1))
    some = rows.select("x", "y").sample(share, 7) if share < 1 else rows.select("x", "y")
    return Tree(np.array([tuple(r) for r in some.collect()], float).reshape(-1, 2), max(per * share, 1.0))


def _xy(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (i, i + 1)], 1)


class Leaves:
    """The samples of a call: tree, packed leaves (leaf, part, n, data), and their boxes."""

    def __init__(self, samples: DataFrame, per: int, at_place: int | None, part: int = 1 << 30):
        ship_code(samples.sparkSession)
        rows = samples.select(F.col("sid").cast("long").alias("sid"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "v")])
        rows = rows.where("x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('inf') and abs(y) < double('inf')")
        if at_place is not None:
            rows = rows.withColumn("r", F.row_number().over(W.partitionBy("x", "y").orderBy("sid", "v"))).where(F.col("r") <= at_place).drop("r")
        rows = written(rows, "samples")
        self.n = rows.count()
        per = max(per, self.n // (_LEAVES // 2))
        self.tree = tree = tree_of(rows, self.n, per)

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(tree.of(_xy(b, 1)), pa.int64()), *b.columns], names=["leaf", "sid", "x", "y", "v"])

        at = rows.mapInArrow(numbered, "leaf long, sid long, x double, y double, v double")
        at = written(at.withColumn("no", F.monotonically_increasing_id()), "leaf_rows")
        size = at.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        found = sorted(size.collect(), key=lambda r: r["leaf"])  # a row per leaf
        self.ids = np.array([r["leaf"] for r in found], np.int64)
        self.count = np.array([r["n"] for r in found], np.int64)
        self.box = np.array([[r["x0"], r["x1"], r["y0"], r["y1"]] for r in found], float).reshape(-1, 4)
        parts = F.broadcast(samples.sparkSession.createDataFrame([(int(i), int(-(-n // part))) for i, n in zip(self.ids, self.count)], "leaf long, parts long"))  # a row per leaf

        def packed(t: pa.Table) -> pa.Table:
            order = np.lexsort((t["v"].to_numpy(), t["sid"].to_numpy()))
            column = lambda c, kind: t[c].to_numpy()[order].astype(kind).tobytes()
            data = column("sid", "<i8") + b"".join(column(c, "<f8") for c in ("x", "y", "v"))
            return pa.table({"leaf": [t["leaf"][0].as_py()], "part": [t["part"][0].as_py()], "n": [len(t)], "data": [data]}, schema=pa.schema([("leaf", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))

        cut = at.join(parts, "leaf").withColumn("part", F.col("no") % F.col("parts"))
        self.packed = written(cut.groupBy("leaf", "part").applyInArrow(packed, "leaf long, part long, n long, data binary"), "leaves")

    def apart(self, boxes: np.ndarray) -> np.ndarray:
        """Distances of boxes (x0, x1, y0, y1) from those of the leaves, a row each."""
        return gaps(boxes, self.box)


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of boxes (x0, x1, y0, y1) from others, a row for each of the first."""
    gap = lambda i: np.maximum(np.maximum(a[:, None, i] - b[None, :, i + 1], b[None, :, i] - a[:, None, i + 1]), 0.0)
    return np.hypot(gap(0), gap(2))


def unpack(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sid, places, values) of packed leaves, by sid."""
    cells = [np.frombuffer(d, "<i8").reshape(4, -1) for d in data]
    flat = np.concatenate(cells, 1) if cells else np.zeros((4, 0), np.int64)
    flat = flat[:, np.argsort(flat[0], kind="stable")]
    return flat[0], np.stack([flat[1].view(float), flat[2].view(float)], 1), flat[3].view(float)


_NEAR = pa.list_(pa.struct([("d2", pa.float64()), ("sid", pa.int64()), ("sx", pa.float64()), ("sy", pa.float64()), ("sv", pa.float64())]))
_NEAR_SQL = "array<struct<d2: double, sid: bigint, sx: double, sy: double, sv: double>>"


def ranked(at: np.ndarray, sid: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the n nearest places, their squared distances) of each target, nearest first, ties by sid; places come by sid."""
    n = min(n, len(places))
    rows, dist = np.zeros((len(at), n), np.int64), np.zeros((len(at), n))
    if not n:
        return rows, dist
    step = max(1, _STEP // len(places))
    for a in range(0, len(at), step):
        q = at[a : a + step]
        d2 = (q[:, None, 0] - places[None, :, 0]) ** 2 + (q[:, None, 1] - places[None, :, 1]) ** 2
        near = np.sort(np.argpartition(d2, n - 1, axis=1)[:, :n], axis=1) if n < len(places) else np.broadcast_to(np.arange(n), (len(q), n)).copy()
        own = np.take_along_axis(d2, near, 1)
        if n < len(places):  # places as near as the n-th: those of least sid
            last = own.max(1)
            for i in np.flatnonzero((d2 <= last[:, None]).sum(1) > n).tolist():
                less = np.flatnonzero(d2[i] < last[i])
                near[i] = np.sort(np.concatenate([less, np.flatnonzero(d2[i] == last[i])[: n - len(less)]]))
                own[i] = d2[i, near[i]]
        order = np.argsort(own, axis=1, kind="stable")
        rows[a : a + step], dist[a : a + step] = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    return rows, dist


def _meet(n: int, reach: dict[int, float]):
    """Targets of a group and packed leaves -> targets with their nearest, and whether they are settled."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        sid, places, v = unpack([x.as_py() for x in right["data"]])
        at = np.stack([left["x"].to_numpy(), left["y"].to_numpy()], 1)
        rows, d2 = ranked(at, sid, places, n)
        flat = rows.reshape(-1)
        fields = [pa.array(d2.reshape(-1)), pa.array(sid[flat]), pa.array(places[flat, 0]), pa.array(places[flat, 1]), pa.array(v[flat], from_pandas=True)]
        near = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * rows.shape[1], pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_NEAR.value_type)))
        far = d2[:, -1] if rows.shape[1] else np.zeros(len(at))
        settled = np.sqrt(far) < reach[key[0].as_py()] if rows.shape[1] else np.ones(len(at), bool)
        return pa.table([*[left[c] for c in ("id", "x", "y", "no", "leaf")], near, pa.array(settled), pa.array(np.sqrt(far))], names=["id", "x", "y", "no", "leaf", "near", "settled", "far"])

    return run


def _met(targets: DataFrame, leaves: Leaves, n: int, kind: str, radius: dict[int, float] | None = None) -> DataFrame:
    """``targets`` (id, x, y, no, leaf), a written table, with near, settled and far; radius by leaf, else as far as n samples may lie."""
    spark = targets.sparkSession
    size = targets.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect()  # a row per leaf
    pairs, parts, reach = [], [], {}
    for a in range(0, len(size), 256):
        part = size[a : a + 256]
        apart = leaves.apart(np.array([[r["x0"], r["x1"], r["y0"], r["y1"]] for r in part], float))
        for r, d in zip(part, apart):
            if radius is None:
                order = np.argsort(d, kind="stable")
                enough = np.flatnonzero(np.cumsum(leaves.count[order]) >= min(n, leaves.n))
                own = leaves.box[np.searchsorted(leaves.ids, r["leaf"])] if r["leaf"] in leaves.ids else None
                usual = 0.0 if own is None else 1.3 * np.sqrt(max((own[1] - own[0]) * (own[3] - own[2]), 0) * n / (np.pi * max(leaves.count[np.searchsorted(leaves.ids, r["leaf"])], 1)))
                most = max(float(d[order[enough[0]]]) if len(enough) else np.inf, usual)
            else:
                most = radius[r["leaf"]]
            some = np.flatnonzero(d <= most)
            reach[r["leaf"]] = np.inf if len(some) == len(d) else float(d[d > most].min())
            pairs += [(r["leaf"], int(i)) for i in leaves.ids[some]]
            parts.append((r["leaf"], int(-(-r["n"] // _GROUP))))
    parts = F.broadcast(spark.createDataFrame(parts, "leaf long, parts long"))  # a row per leaf
    groups = targets.join(parts, "leaf").withColumn("part", F.col("no") % F.col("parts")).groupBy("leaf", "part")
    meets = spark.createDataFrame(pa.table({"leaf": pa.array([p[0] for p in pairs], pa.int64()), "of": pa.array([p[1] for p in pairs], pa.int64())}))
    given = meets.join(parts, "leaf").select("of", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    given = given.join(leaves.packed.select(F.col("leaf").alias("of"), "data"), "of").select("leaf", "part", "data")
    out = f"id {kind}, x double, y double, no long, leaf long, near {_NEAR_SQL}, settled boolean, far double"
    # targets without a leaf around them (no samples) would have no group on the right: cogroup keeps them
    return groups.cogroup(given.groupBy("leaf", "part")).applyInArrow(_meet(n, reach), out)


def numbered(targets: DataFrame, leaves: Leaves) -> tuple[DataFrame, str]:
    """A written table (id, x, y, no, leaf) of all target rows, leaf -1 where a coordinate is null or not finite, and the id's type."""
    kind = dict(targets.dtypes)["id"]
    tree = leaves.tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.of(_xy(b, 1)), pa.int64())], names=["id", "x", "y", "leaf"])

    at = targets.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInArrow(run, f"id {kind}, x double, y double, leaf long")
    return written(at.select("id", "x", "y", F.monotonically_increasing_id().alias("no"), "leaf"), "targets"), kind


def nearest_of(targets: DataFrame, leaves: Leaves, n: int) -> DataFrame:
    """(id, x, y, no, leaf, near), a row per target row: its n nearest samples, nearest first, ties by sid."""
    at, kind = numbered(targets, leaves)
    good = at.where("leaf >= 0")
    names = ["id", "x", "y", "no", "leaf", "near"]
    none = (at if not leaves.n else at.where("leaf < 0")).select("id", "x", "y", "no", "leaf", F.array().cast(_NEAR_SQL).alias("near"))
    if not leaves.n:
        return none
    first = written(_met(good, leaves, n, kind), "near")
    open_ = first.where("not settled")
    radius = {r["leaf"]: r["far"] for r in open_.groupBy("leaf").agg(F.max("far").alias("far")).collect()}  # a row per leaf
    out = first.where("settled").select(*names).unionByName(none)
    if radius:
        out = out.unionByName(written(_met(open_.select("id", "x", "y", "no", "leaf"), leaves, n, kind, radius), "near_more").select(*names))
    return out


def at_places(targets: DataFrame, solve) -> DataFrame:
    """(id, x, y, v), a row per target row, from ``solve``: (id, x, y) of the different places, all with id 0 -> (id, x, y, v). Targets at one place are solved once."""
    own = targets.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = own.where("x is not null and y is not null").select("x", "y").distinct()
    solved = solve(places.select(F.lit(0).cast("long").alias("id"), "x", "y")).select("x", "y", "v")
    return own.join(solved, ["x", "y"], "left").select("id", "x", "y", "v")


def flat(near: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, d2, places, values) of a column ``near``, entries of all rows one after another."""
    if isinstance(near, pa.ChunkedArray):
        near = near.combine_chunks()
    sizes = pc.list_value_length(near).fill_null(0).to_numpy()
    entries = near.flatten()
    get = lambda c: pc.struct_field(entries, c).to_numpy(zero_copy_only=False)
    return sizes, get("d2"), np.stack([get("sx"), get("sy")], 1), get("sv")
