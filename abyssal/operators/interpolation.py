"""Trilinear interpolation and gap filling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abyssal.functions.rows import carried, restored
from abyssal.operators.grid import Grid, axis_array, lower_node
from abyssal.operators.natural import by_distance, natural_of
from abyssal.operators.nearest import Leaves, Tree, at_places, flat, gaps, nearest_of, tree_of
from abyssal.session import ship_code, written

#: Doubles of the corner table up to which it is broadcast; a larger one is shuffled by (i, j, slab).
MOST_BROADCAST = 20_000_000
#: Intervals of depth that a corner block spans; a deeper axis is cut into slabs.
SLAB = 64


def corner_blocks(cube: DataFrame, grid: Grid) -> DataFrame:
    """(i, j, slab, a00, a10, a01, a11): for each grid square and slab the value columns over z at its four corners.

    A slab holds the levels from SLAB * slab to SLAB * (slab + 1), both included.
    """
    wide = min(len(grid.zs), SLAB + 1)
    own = cube.select("i", "j", "v", F.expr(f"k div {SLAB}").alias("slab"), (F.col("k") % SLAB).alias("m"))
    if len(grid.zs) > wide:  # a level on the edge of two slabs is in both
        own = own.union(cube.where((F.col("k") % SLAB == 0) & (F.col("k") > 0)).select("i", "j", "v", F.expr(f"k div {SLAB} - 1"), F.lit(SLAB)))
    levels = F.array(*[F.max(F.when(F.col("m") == m, F.col("v"))) for m in range(wide)])
    columns = own.groupBy("i", "j", "slab").agg(levels.alias("a"))
    spread = columns.select(F.explode(F.array(*[F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(2 * dj + di).alias("c")) for di in (0, 1) for dj in (0, 1)])).alias("s"), "slab", "a")
    spread = spread.where(F.col("s.i").between(0, grid.nx - 2) & F.col("s.j").between(0, grid.ny - 2))
    corner = lambda c: F.max(F.when(F.col("s.c") == c, F.col("a")))  # noqa: E731  one row per corner: max picks it
    return spread.groupBy(F.col("s.i").cast("int").alias("i"), F.col("s.j").cast("int").alias("j"), F.col("slab").cast("int").alias("slab")).agg(corner(0).alias("a00"), corner(1).alias("a10"), corner(2).alias("a01"), corner(3).alias("a11"))


def _lower(v: Column, origin: float, step: float, n: int) -> Column:
    return F.least(F.greatest(F.floor((v - F.lit(origin)) / F.lit(step)), F.lit(0)), F.lit(n - 2)).cast("int")


def _bracket(v: Column, axis: tuple[float, ...] | None, origin: float, step: float, n: int) -> Column:
    """The interval of a value: in closed form on a regular axis, by binary search on any other."""
    if axis is None:
        return _lower(v, origin, step, n)
    return lower_node(v, axis)


def _share(v: Column, at: Column, axis: tuple[float, ...] | None, origin: float, step: float) -> Column:
    if axis is None:
        return (v - (F.lit(origin) + at * F.lit(step))) / F.lit(step)
    nodes = axis_array(axis)
    return (v - F.get(nodes, at)) / (F.get(nodes, at + 1) - F.get(nodes, at))


def edge_clamp(points: DataFrame, grid: Grid, deepest: float = 5500.0, at: float = 5499.0) -> DataFrame:
    """x and y moved onto the grid, depths from ``deepest`` on to ``at``, depths above the sea to 0."""
    xmin, ymin, xmax, ymax = map(F.lit, grid.extent)
    return points.withColumns({
        "x": F.least(F.greatest("x", xmin), xmax),
        "y": F.least(F.greatest("y", ymin), ymax),
        "d": F.when(F.col("d") >= deepest, F.lit(at)).when(F.col("d") < 0, F.lit(0.0)).otherwise(F.col("d")),
    })


def point_flags(points: DataFrame, grid: Grid, deepest: float = 5500.0) -> DataFrame:
    """Where a point lies: across (Left, Right), along (Bot, Top) and in depth (Deep, Land), OK inside."""
    xmin, ymin, xmax, ymax = grid.extent
    along = F.when(F.col("y") < ymin, "Bot").when(F.col("y") > ymax, "Top").otherwise("")
    across = F.when(F.col("x") < xmin, "Left").when(F.col("x") > xmax, "Right").otherwise("")
    deep = F.when(F.col("d") >= deepest, "Deep").when(F.col("d") < 0, "Land").otherwise("")
    place = F.concat(along, across)
    return points.withColumn("flag", F.concat(F.when(place == "", "OK").otherwise(place), deep))


def tile_flags(points: DataFrame, edges: DataFrame, grid: Grid, deepest: float = 5500.0, tile: str = "tile_id") -> DataFrame:
    """points with ``flag``, as a run over tiles marks them.

    In a tile within the grid: 'Flag 4' where a depth is moved onto the axis (too deep, or land), 'Flag 3' without a depth,
    else 'Flag 2'. In an edge tile the place: Top, Bottom, Left, Right, or two as BotLeft and UpRight, OK inside and on
    the border; Deep is added from ``deepest`` on (BotDeep for the bottom), 'Flagged 1' without a depth.
    """
    xmin, ymin, xmax, ymax = grid.extent
    x, y, d = F.col("x"), F.col("y"), F.col("d")
    side = F.when(x < xmin, "Left").when(x > xmax, "Right").otherwise("")
    deep = d >= deepest
    low, high = y < ymin, y > ymax
    place = F.when(low & (side != ""), F.concat(F.lit("Bot"), side)).when(high & (side != ""), F.concat(F.lit("Up"), side)).when(high, "Top")
    place = place.when(low, F.when(deep, "Bot").otherwise("Bottom")).when(side != "", side).otherwise("OK")
    edge = F.when(d.isNull(), "Flagged 1").when(deep, F.concat(place, F.lit("Deep"))).otherwise(place)
    inner = F.when(d.isNull(), "Flag 3").when(deep | (d < 0), "Flag 4").otherwise("Flag 2")
    at = points.select(carried(points).alias("_row"), "x", "y", "d").join(edges.select(F.col(tile).alias("_tile"), F.col("edge").alias("_edge")), F.col(f"_row.`{tile}`") == F.col("_tile"))
    return restored(at, points, "_row", flag=F.when(F.col("_edge"), edge).otherwise(inner))


def nearest_depth(points: DataFrame, grid: Grid, out: str = "z") -> DataFrame:
    """points with the axis depth nearest to ``d``; the shallower of two as near."""
    k, zs = lower_node(F.col("d"), grid.zs), axis_array(grid.zs)
    low, high = F.get(zs, k), F.get(zs, k + 1)
    return points.withColumn(out, F.when(F.col("d").isNotNull(), F.when(F.col("d") - low <= high - F.col("d"), low).otherwise(high)))


def trilinear(points: DataFrame, cube: DataFrame, grid: Grid, bounds: str = "null") -> DataFrame:
    """points (x, y, d) with ``tri``. One equi-join per point, then a closed form; no UDF.

    bounds: 'null' leaves points outside without a value, 'error' fails when there are any, 'clamp' moves them onto the
    grid. A NULL corner gives NULL, even at weight 0, and so does a NULL coordinate. The last interval of each axis is closed.
    Axes may be uneven. Other columns are kept whatever their names; one named tri is replaced.
    """
    place = points.select(carried(points).alias("_row"), *[F.col(c) for c in ("x", "y", "d")])
    if bounds == "clamp":
        place = edge_clamp(place, grid)
    xmin, ymin, xmax, ymax = map(float, grid.extent)
    nz = len(grid.zs)
    inside = F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax) & F.col("d").between(float(grid.zs[0]), float(grid.zs[-1]))
    if bounds == "error" and (n := points.where(~inside).count()):
        raise ValueError(f"{n} points are outside the grid")
    at = place.select("*", _bracket(F.col("x"), grid.xs, grid.x0, grid.dx, grid.nx).alias("_i"), _bracket(F.col("y"), grid.ys, grid.y0, grid.dy, grid.ny).alias("_j"), lower_node(F.col("d"), grid.zs).alias("_k"))
    at = at.withColumns({"_s": F.expr(f"cast(_k div {SLAB} as int)"), "_m": F.col("_k") % SLAB})
    blocks = corner_blocks(cube, grid)
    if grid.nx * grid.ny * nz * 4 <= MOST_BROADCAST:
        blocks = F.broadcast(blocks)
    at = at.join(blocks, (F.col("_i") == F.col("i")) & (F.col("_j") == F.col("j")) & (F.col("_s") == F.col("slab")), "left")
    tx, ty, tz = _share(F.col("x"), F.col("_i"), grid.xs, grid.x0, grid.dx), _share(F.col("y"), F.col("_j"), grid.ys, grid.y0, grid.dy), _share(F.col("d"), F.col("_k"), grid.zs, 0.0, 1.0)

    def plane(step: int) -> Column:
        v = {c: F.get(F.col(c), F.col("_m") + step) for c in ("a00", "a10", "a01", "a11")}
        return (v["a00"] * (1 - tx) + v["a10"] * tx) * (1 - ty) + (v["a01"] * (1 - tx) + v["a11"] * tx) * ty

    value = plane(0) * (1 - tz) + plane(1) * tz
    return restored(at, points, "_row", tri=F.when(inside, value))


def row_pad(cells: DataFrame) -> DataFrame:
    """(k, i, j, v) with gaps filled along rows i of each layer k.

    A gap takes the right-most good value of its row; a row without any lies on the line between the right-most value of
    the row before and the left-most of the row after that have one; the ends are held.
    """
    rows = cells.groupBy("k", "i").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("j"))).alias("rg"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("j"))).alias("lg"))
    good = F.col("rg").isNotNull()
    before = W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("k").orderBy("i").rowsBetween(1, W.unboundedFollowing)
    here = F.when(good, F.struct("i", "rg", "lg"))
    rows = rows.withColumns({"p": F.last(here, True).over(before), "n": F.first(here, True).over(after)})
    line = (F.col("n.lg") - F.col("p.rg")) / (F.col("n.i") - F.col("p.i")) * (F.col("i") - F.col("p.i")) + F.col("p.rg")
    fill = F.when(good, F.col("rg")).when(F.col("p").isNull(), F.col("n.lg")).when(F.col("n").isNull(), F.col("p.rg")).otherwise(line)
    return cells.join(rows.select("k", "i", fill.alias("fill")), ["k", "i"]).select("k", "i", "j", F.coalesce("v", "fill").alias("v"))


def _leaf(n: int, leaf: int | None) -> int:
    return leaf or max(256, 16 * n)


def nearest(targets: DataFrame, samples: DataFrame, n: int, leaf: int | None = None) -> DataFrame:
    """(id, x, y, near), a row per target row: its n nearest samples as an array, nearest first, ties by sid.

    Samples are (sid, x, y, v); those without a finite place are left out, and a target without one has none. ``leaf`` is the
    usual number of samples of a leaf of the index.
    """
    return nearest_of(targets, Leaves(samples, _leaf(n, leaf), n), n).select("id", "x", "y", "near")


def neighbours(targets: DataFrame, samples: DataFrame, n: int, leaf: int | None = None) -> DataFrame:
    """(id, x, y, sid, sx, sy, sv, d2, rank): ``nearest`` as rows, ranks from 1."""
    rows = nearest(targets, samples, n, leaf).select("id", "x", "y", F.posexplode("near").alias("rank", "e"))
    return rows.select("id", "x", "y", "e.sid", "e.sx", "e.sy", "e.sv", "e.d2", (F.col("rank") + 1).alias("rank"))


def _solved(targets: DataFrame, samples: DataFrame, n: int, leaf: int | None, solve) -> DataFrame:
    """``solve(p, v, at, d2)`` on stacked systems of the same size: p (b, m, 2), v (b, m), at (b, 2), d2 (b, m) -> b values; NULL without samples."""

    def run(batches):
        for batch in batches:
            sizes, d2, p, v = flat(batch.column(3))
            at = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)], 1)
            out, starts = np.full(batch.num_rows, np.nan), np.cumsum(sizes) - sizes
            for m in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == m)
                e = starts[rows][:, None] + np.arange(m)
                out[rows] = solve(p[e], v[e], at[rows], d2[e])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(out, from_pandas=True)], names=["id", "x", "y", "v"])

    return at_places(targets, lambda places: nearest(places, samples, n, leaf).mapInArrow(run, "id long, x double, y double, v double"))


def idw(targets: DataFrame, samples: DataFrame, n: int = 10, leaf: int | None = None) -> DataFrame:
    """(id, x, y, v): inverse squared distance over the n nearest samples; a sample at the very place decides alone."""
    return _solved(targets, samples, n, leaf, lambda p, v, at, d2: by_distance(d2, v))


def _apart(p: np.ndarray) -> np.ndarray:
    return np.hypot(*np.moveaxis(p[:, :, None] - p[:, None], -1, 0))


def _merged(p: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, p, v) of stacked samples with those of one place as one, of their mean; a part for each number of places.

    Systems with equal rows are singular; their least-norm solution shares a place's weight among its samples, which is the same.
    """
    b, m = v.shape
    order = np.lexsort((p[:, :, 1], p[:, :, 0]), axis=1)
    p, v = np.take_along_axis(p, order[:, :, None], 1), np.take_along_axis(v, order, 1)
    fresh = np.concatenate([np.ones((b, 1), bool), (p[:, 1:] != p[:, :-1]).any(2)], 1)
    count = fresh.sum(1)
    for k in np.unique(count).tolist():
        rows = np.flatnonzero(count == k)
        own = fresh[rows]
        if k == m:
            yield rows, p[rows], v[rows]
            continue
        starts = np.flatnonzero(own)
        mean = np.add.reduceat(v[rows].reshape(-1), starts) / np.diff(np.append(starts, own.size))
        yield rows, p[rows][own].reshape(-1, k, 2), mean.reshape(-1, k)


def _linear(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of stacked systems; the least-norm one of each that has no other."""
    try:
        x = np.linalg.solve(a, b[..., None])[..., 0]
        bad = ~(np.abs(x).max(1) < 1e12)  # not finite, too
    except np.linalg.LinAlgError:
        x, bad = np.zeros_like(b), np.ones(len(b), bool)
        if len(b) > 1:
            half = len(b) // 2
            return np.concatenate([_linear(a[:half], b[:half]), _linear(a[half:], b[half:])])
    if bad.any():
        x[bad] = (np.linalg.pinv(a[bad]) @ b[bad][..., None])[..., 0]
    return x


def spherical(h: np.ndarray, span: float, sill: float, nugget: float) -> np.ndarray:
    r = np.minimum(h / span, 1.0)
    return np.where(h > 0, nugget + sill * (1.5 * r - 0.5 * r**3), 0.0)


#: Leaves that the variogram's places are dealt to: a leaf travels to those within reach, so what travels is a bounded multiple of the places.
_LEAVES = 64


def _compact(cells: np.ndarray, per: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (rows x, y, n, s, q) in compact blocks one after the other, the blocks' edges and boxes."""
    of = Tree(cells[:2].T, per).of(cells[:2].T)
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.diff(of[order], prepend=-1))
    cells = cells[:, order]
    ends = lambda f, i: f.reduceat(cells[i], starts)
    return cells, np.append(starts, len(order)), np.stack([ends(np.minimum, 0), ends(np.maximum, 0), ends(np.minimum, 1), ends(np.maximum, 1)], 1)


def _pair_sums(a: np.ndarray, b: np.ndarray, same: bool, reach: float, lags: int) -> np.ndarray:
    """(lags, 3) sums as of ``lag_sums`` (the second not yet halved) over the pairs of places of two leaves, block by block; or of one leaf with itself."""
    a, ends_a, box_a = _compact(a)
    b, ends_b, box_b = (a, ends_a, box_a) if same else _compact(b)
    out = np.zeros((lags, 3))
    near = gaps(box_a, box_b)
    span = lambda i: np.maximum(box_a[:, None, i + 1] - box_b[None, :, i], box_b[None, :, i + 1] - box_a[:, None, i])
    far = np.hypot(span(0), span(2))
    for i, j in zip(*(x.tolist() for x in np.nonzero(near <= reach * (1 + 1e-12)))):
        if same and j < i:
            continue
        p, q = a[:, ends_a[i] : ends_a[i + 1]], b[:, ends_b[j] : ends_b[j + 1]]
        d = p[0][:, None] - q[0][None]
        d *= d
        other = p[1][:, None] - q[1][None]
        other *= other
        d += other
        low, high = int(near[i, j] * (lags / reach) * (1 - 1e-12)), int(far[i, j] * (lags / reach) * (1 + 1e-12))
        part = np.zeros((lags, 3))
        if low == high and near[i, j] > 0 and high < lags:  # all in one lag
            np.sqrt(d, out=d)
            (n, s, u), (m, t, w) = p[2:].sum(1), q[2:].sum(1)
            part[low] = p[2] @ (d @ q[2]), n * w + u * m - 2 * s * t, n * m
        else:
            keep = (d > 0) & (d <= reach * reach)
            np.sqrt(d, out=d)
            lag = np.minimum((d * (lags / reach)).astype(np.int32), lags - 1)
            for k in range(low, min(high, lags - 1) + 1):
                some = ((lag == k) & keep).astype(float)
                m, t, w = (some @ q[2:].T).T
                some *= d
                part[k] = p[2] @ (some @ q[2]), p[2] @ w + p[4] @ m - 2 * (p[3] @ t), p[2] @ m
        out += part / 2 if same and i == j else part  # a block with itself has each pair twice
    return out


def lag_sums(samples: DataFrame, reach: float, lags: int = 12, leaf: int = 1_000) -> list[tuple[float, float, int]]:
    """(sum of distances, sum of half the squared differences, pairs) by lag, over all pairs of samples at most ``reach`` apart.

    Samples at one place are one row of their number, sum and sum of squares, which is all that pairs with other places need.
    Leaves of places meet those within reach, each pair of leaves once; a row per lag and task comes together. Pairs at one
    place are left out, and so are values that are null or not finite.
    """
    spark = samples.sparkSession
    good = samples.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "v")])
    good = good.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in ("x", "y", "v")))
    middle = F.lit(good.agg((F.min("v") / 2 + F.max("v") / 2).alias("m")).first()["m"]).cast("double")  # keeps the squares' digits
    v = F.col("v") - middle
    ship_code(spark)
    places = written(good.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")), "variogram_places")
    total = places.count()
    if not total:
        return [(0.0, 0.0, 0)] * lags
    tree = tree_of(places, total, max(leaf, total // _LEAVES))
    names = ["x", "y", "n", "s", "q"]

    def numbered(batches):
        for batch in batches:
            xy = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(tree.of(xy), pa.int64()), *batch.columns], names=["leaf", *names])

    def packed(t):
        cells = np.stack([t[c].to_numpy() for c in names])
        cells = cells[:, np.lexsort((cells[1], cells[0]))]
        return pa.table({"leaf": t["leaf"][:1], "x0": [cells[0].min()], "x1": [cells[0].max()], "y0": [cells[1].min()], "y1": [cells[1].max()], "data": [cells.tobytes()]})

    leaves = places.select(*names).mapInArrow(numbered, "leaf long, " + ", ".join(f"{c} double" for c in names))
    leaves = written(leaves.groupBy("leaf").applyInArrow(packed, "leaf long, x0 double, x1 double, y0 double, y1 double, data binary"), "variogram_leaves")
    found = leaves.drop("data").collect()  # a row per leaf
    box = np.array([r[1:] for r in found], float)
    pairs = [(found[i]["leaf"], found[j]["leaf"]) for i, j in zip(*np.nonzero(gaps(box, box) <= reach)) if i <= j]
    side = lambda c: leaves.select(F.col("leaf").alias(c), F.col("data").alias(f"d{c}"))
    met = spark.createDataFrame(pairs, "a long, b long").join(side("a"), "a").join(side("b"), "b").select((F.col("a") == F.col("b")).alias("same"), "da", "db")
    met = met.repartition(min(len(pairs), 1024))  # a pair is much work on little data

    def run(batches):
        sums = np.zeros((lags, 3))
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_py(), float).reshape(5, -1) for c in (1, 2))
                sums += _pair_sums(a, b, batch.column(0)[i].as_py(), reach, lags)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lags)), pa.array(sums[:, 0]), pa.array(np.maximum(sums[:, 1], 0) / 2), pa.array(np.rint(sums[:, 2]).astype(np.int64))], names=["lag", "h", "g", "n"])

    got = {r["lag"]: r for r in met.mapInArrow(run, "lag long, h double, g double, n long").groupBy("lag").agg(*[F.sum(c).alias(c) for c in ("h", "g", "n")]).collect()}
    return [(got[i]["h"], got[i]["g"], got[i]["n"]) if i in got else (0.0, 0.0, 0) for i in range(lags)]


def variogram(samples: DataFrame, reach: float | None = None, lags: int = 12) -> tuple[float, float, float]:
    """(span, sill, nugget) of a spherical variogram fitted to half the mean squared differences of all pairs up to ``reach``, by lag.

    Without ``reach`` it is a sixth of the extent's diagonal. Spans are tried in turn; sill and nugget follow by least squares.
    """
    if reach is None:
        r = samples.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        reach = math.hypot(r[1] - r[0], r[3] - r[2]) / 6 if r[0] is not None else 0.0
    sums = [s for s in lag_sums(samples, reach, lags) if s[2]] if reach else []
    if not sums:
        return 1.0, 1.0, 0.0
    w = np.array([s[2] for s in sums], float)
    h, g = np.array([s[0] for s in sums]) / w, np.array([s[1] for s in sums]) / w
    best = (np.inf, float(reach), float(g.mean()) or 1.0, 0.0)
    for span in np.linspace(0.1, 3.0, 59) * reach:
        base = spherical(h, span, 1.0, 0.0)
        for columns in (np.stack([base, np.ones(len(h))], 1), base[:, None]):  # with and without a nugget
            x = np.linalg.lstsq(columns * np.sqrt(w)[:, None], g * np.sqrt(w), rcond=None)[0]
            if (x >= 0).all() and x[0] > 0:
                miss = float((w * (columns @ x - g) ** 2).sum())
                if miss < best[0]:
                    best = (miss, float(span), float(x[0]), float(x[1]) if len(x) > 1 else 0.0)
    return best[1:]


def kriging(targets: DataFrame, samples: DataFrame, n: int = 10, leaf: int | None = None, model: tuple[float, float, float] | None = None) -> DataFrame:
    """Ordinary kriging over the n nearest samples, with the spherical variogram (span, sill, nugget) given or fitted."""
    span, sill, nugget = model or variogram(samples)

    def solve(p, v, at, d2):
        out = np.zeros(len(v))
        for rows, own, mean in _merged(p, v):
            b, m = mean.shape
            a = np.ones((b, m + 1, m + 1))
            a[:, :m, :m] = spherical(_apart(own), span, sill, nugget)
            a[:, m, m] = 0
            right = np.ones((b, m + 1))
            right[:, :m] = spherical(np.hypot(*np.moveaxis(own - at[rows, None], -1, 0)), span, sill, nugget)
            out[rows] = (_linear(a, right)[:, :m] * mean).sum(1)
        return out

    return _solved(targets, samples, n, leaf, solve)


def tension(h: np.ndarray, weight: float) -> np.ndarray:
    """The basis function of a spline with tension; 0 at 0. The Bessel function K0 is a power series up to 2, beyond it its integral by the trapezoid rule."""
    x = np.maximum(h, 1e-12) * math.sqrt(weight)
    q = np.minimum(x, 2.0) ** 2 / 4
    i0, rest, term, harmonic = np.ones_like(x), np.zeros_like(x), np.ones_like(x), 0.0
    for k in range(1, 19):
        harmonic += 1 / k
        term = term * q / (k * k)
        i0 += term
        rest += term * harmonic
    start = np.log(x / 2) + 0.5772156649015329
    both = start * (1 - i0) + rest  # log(x / 2) + Euler's constant + K0(x), without their cancellation
    far = x > 2
    if far.any():
        y, k0 = x[far], np.zeros(int(far.sum()))
        for i in range(21):
            k0 += (0.1 if i == 0 else 0.2) * np.exp(-np.minimum(y * math.cosh(0.2 * i), 700.0))
        both[far] = start[far] + k0
    return np.where(h > 1e-12, -both / (2 * math.pi * weight), 0.0)


def spline(targets: DataFrame, samples: DataFrame, n: int = 10, leaf: int | None = None, weight: float = 0.1) -> DataFrame:
    """Spline with tension ``weight`` and a constant trend over the n nearest samples; exact at samples."""

    def solve(p, v, at, d2):
        out = np.zeros(len(v))
        for rows, own, mean in _merged(p, v):
            b, m = mean.shape
            a = np.ones((b, m + 1, m + 1))
            a[:, :m, :m] = tension(_apart(own), weight)
            a[:, m, m] = 0
            c = _linear(a, np.concatenate([mean, np.zeros((b, 1))], 1))
            out[rows] = (tension(np.hypot(*np.moveaxis(own - at[rows, None], -1, 0)), weight) * c[:, :m]).sum(1) + c[:, m]
        return out

    return _solved(targets, samples, n, leaf, solve)


def _natural(places: DataFrame, samples: DataFrame, n: int, leaf: int | None, first: int = 24) -> DataFrame:
    leaves = Leaves(samples, _leaf(n, leaf), 1)  # of samples at one place only the first counts
    near = nearest_of(places, leaves, max(first, n))
    if not leaves.n:
        return near.select("id", "x", "y", F.lit(None).cast("double").alias("v"))
    return natural_of(near, leaves, dict(places.dtypes)["id"])


def natural_neighbour(targets: DataFrame, samples: DataFrame, n: int = 10, leaf: int | None = None) -> DataFrame:
    """(id, x, y, v): natural neighbours, whatever their number; NULL outside the samples' convex hull. Of samples at one place the one of least sid counts."""
    return at_places(targets, lambda places: _natural(places, samples, n, leaf))


def natural_then_idw(targets: DataFrame, samples: DataFrame, n: int = 10, leaf: int | None = None) -> DataFrame:
    """(id, x, y, v): natural neighbours, and by distance over the n nearest where there is none; only these places are searched again."""

    def solve(places: DataFrame) -> DataFrame:
        natural = written(_natural(places, samples, n, leaf), "natural_values")
        left = natural.where("v is null")
        return natural if left.isEmpty() else natural.where("v is not null").unionByName(idw(left.select("id", "x", "y"), samples, n, leaf))

    return at_places(targets, solve)


def first_of(natural: DataFrame, weighed: DataFrame) -> DataFrame:
    """The natural-neighbour value where there is one, the weighed value elsewhere."""
    other = weighed.select("id", F.col("v").alias("_w"))
    return natural.join(other, "id", "full").select("id", F.coalesce("v", "_w").alias("v"))
