"""Grids: axes, layer catalogs, fishnets, cell lookups."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abyssal.functions.raster import PROJECTIONS
from abyssal.functions.rows import carried, restored


@dataclass(frozen=True)
class Grid:
    """A cube's axes: any increasing depths in z; x and y regular, or any increasing coordinates where xs and ys are given."""

    nx: int
    ny: int
    zs: tuple[float, ...]
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    xs: tuple[float, ...] | None = None
    ys: tuple[float, ...] | None = None
    extent: tuple[float, float, float, float] = field(init=False)

    def __post_init__(self):
        for axis, n in ((self.xs, self.nx), (self.ys, self.ny), (self.zs, len(self.zs))):
            if axis is not None and (len(axis) != n or n < 2 or any(a >= b for a, b in zip(axis, axis[1:]))):
                raise ValueError("an axis has at least two coordinates, each above the one before, and as many as the grid")
        x1, y1 = self.x0 + self.dx * (self.nx - 1), self.y0 + self.dy * (self.ny - 1)
        across, along = (self.xs[0], self.xs[-1]) if self.xs else (self.x0, x1), (self.ys[0], self.ys[-1]) if self.ys else (self.y0, y1)
        object.__setattr__(self, "extent", (across[0], along[0], across[1], along[1]))


def rectilinear(xs: tuple[float, ...], ys: tuple[float, ...], zs: tuple[float, ...]) -> Grid:
    """A grid with uneven axes."""
    return Grid(len(xs), len(ys), tuple(zs), xs=tuple(xs), ys=tuple(ys))


def axis_array(axis: tuple[float, ...]) -> Column:
    """An axis as an array literal, of any length."""
    return F.split(F.lit(",".join(map(repr, map(float, axis)))), ",").cast("array<double>")


def lower_node(v: Column, axis: tuple[float, ...]) -> Column:
    """The node below a value on any increasing axis, by binary search: 0 below the axis, the last but one from there on."""
    n = len(axis)
    nodes = axis_array(axis)
    steps = [1 << i for i in range((n - 1).bit_length())][::-1]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= n - 2) & (F.get(nodes, at + step) <= v), at + step).otherwise(at))


def axis_values(cube: DataFrame, dims: tuple[str, ...] = ("i", "j", "k")) -> DataFrame:
    """(dim, idx, coord, next_coord): the distinct values of each axis in order."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("coord")) for d in dims])).alias("a")
    values = cube.select(each).select("a.dim", "a.coord").distinct()
    by = W.partitionBy("dim").orderBy("coord")
    return values.select("dim", (F.row_number().over(by) - 1).alias("idx"), "coord", F.lead("coord").over(by).alias("next_coord"))


def layer_catalog(names: DataFrame, prefix: str, name_col: str = "name") -> DataFrame:
    """(name, variable, depth_m), from layer names: a prefix, then the depth. Layers without a depth are left out."""
    name = F.col(name_col)
    depth = F.regexp_extract(F.substring(name, len(prefix) + 1, 1000), r"^([0-9]+)$", 1)
    kept = names.where(F.startswith(name, F.lit(prefix)) & (depth != ""))
    return kept.select(name.alias("name"), F.regexp_replace(name, "[0-9]", "").alias("variable"), depth.cast("int").alias("depth_m"))


def require_layers(catalog: DataFrame, least: int = 2) -> None:
    if catalog.limit(least).count() < least:
        raise ValueError(f"an environment needs {least} layers at least")


def fishnet_id(x: Column, y: Column, extent: tuple[float, float, float, float], n: int = 250) -> Column:
    """Cell of an n by n net over (xmin, ymin, xmax, ymax), from the lower left; half-open, NULL outside."""
    xmin, ymin, xmax, ymax = extent
    col = F.floor((x - xmin) / F.lit((xmax - xmin) / n)).cast("int")
    row = F.floor((y - ymin) / F.lit((ymax - ymin) / n)).cast("int")
    return F.when((col >= 0) & (col < n) & (row >= 0) & (row < n), row * n + col)


def fishnet(spark, extent: tuple[float, float, float, float], n: int = 250) -> DataFrame:
    """(id, xmin, ymin, xmax, ymax, wkt) of the net's cells."""
    xmin, ymin, xmax, ymax = map(float, extent)
    w, h = (xmax - xmin) / n, (ymax - ymin) / n
    cells = spark.range(n * n).select(F.col("id").cast("int").alias("id"), F.pmod("id", F.lit(n)).alias("c"), F.floor(F.col("id") / n).alias("r"))
    cells = cells.select("id", (xmin + F.col("c") * w).alias("xmin"), (ymin + F.col("r") * h).alias("ymin"), (xmin + (F.col("c") + 1) * w).alias("xmax"), (ymin + (F.col("r") + 1) * h).alias("ymax"))
    corner = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(" "), F.col(b).cast("string"))
    ring = F.concat_ws(", ", corner("xmin", "ymin"), corner("xmin", "ymax"), corner("xmax", "ymax"), corner("xmax", "ymin"), corner("xmin", "ymin"))
    return cells.withColumns({"wkt": F.concat(F.lit("POLYGON (("), ring, F.lit("))")), "area": F.lit(w * h), "length": F.lit(2 * (w + h))})


def window(raster: DataFrame, row: int, col: int, nrows: int, ncols: int) -> DataFrame:
    """A part of a raster, its own rows and columns counted from 0; the bounds reach the scan."""
    part = raster.where(F.col("row").between(row, row + nrows - 1) & F.col("col").between(col, col + ncols - 1))
    return part.withColumns({"row": (F.col("row") - row).cast("int"), "col": (F.col("col") - col).cast("int")})


def depth_slice(cube: DataFrame, grid: Grid, depth: float) -> DataFrame:
    """(i, j, v) of the layer at a depth of the axis."""
    return cube.where(F.col("k") == grid.zs.index(depth)).select("i", "j", "v")


def sample(points: DataFrame, raster: DataFrame, value: str, out: str) -> DataFrame:
    """points (with row and col) with the raster's value at their cell, NULL where it has none; a column named like ``out`` is replaced."""
    cells = raster.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v"))
    at = points.select(carried(points).alias("_row"))
    return restored(at.join(cells, (F.col("_row.row") == F.col("_r")) & (F.col("_row.col") == F.col("_c")), "left"), points, "_row", **{out: F.col("_v")})


def resample_nearest(raster: DataFrame, factor: int, nrows: int, ncols: int) -> DataFrame:
    """The value at the centre cell of each factor by factor block, by index arithmetic; no shuffle."""
    half = factor // 2
    centre = lambda c, n: F.least(F.floor(F.col(c) / factor) * factor + half, F.lit(n - 1))
    hit = raster.where((F.col("row") == centre("row", nrows)) & (F.col("col") == centre("col", ncols)))
    return hit.select(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col"), "z")


@dataclass(frozen=True)
class Spec:
    """A regular grid from its lower left corner, rows counted from the top."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    cell: float

    @property
    def shape(self) -> tuple[int, int]:
        """Rows and columns."""
        return math.ceil(round((self.ymax - self.ymin) / self.cell, 9)), math.ceil(round((self.xmax - self.xmin) / self.cell, 9))


def cells_of(spark, spec: Spec) -> DataFrame:
    """(row, col, x, y) of all cell centres."""
    nrows, ncols = spec.shape
    cells = spark.range(nrows * ncols).select(F.floor(F.col("id") / ncols).cast("int").alias("row"), F.pmod("id", F.lit(ncols)).cast("int").alias("col"))
    top = spec.ymin + nrows * spec.cell
    return cells.select("row", "col", (F.lit(spec.xmin) + (F.col("col") + 0.5) * F.lit(spec.cell)).alias("x"), (F.lit(top) - (F.col("row") + 0.5) * F.lit(spec.cell)).alias("y"))


def cell_index(x: Column, y: Column, spec: Spec) -> tuple[Column, Column]:
    """(row, col) of the cell that holds a point, NULL outside."""
    nrows, ncols = spec.shape
    col = F.floor((x - F.lit(spec.xmin)) / F.lit(spec.cell)).cast("int")
    row = (F.lit(nrows - 1) - F.floor((y - F.lit(spec.ymin)) / F.lit(spec.cell))).cast("int")
    inside = col.between(0, ncols - 1) & row.between(0, nrows - 1)
    return F.when(inside, row), F.when(inside, col)


def reproject(raster: DataFrame, source: Spec, target: Spec, of: str = "degrees", to: str = "mercator") -> DataFrame:
    """(row, col, z) of ``target`` in the projection ``to``, from a raster in the projection ``of``: the value of the source cell that holds each centre.

    Projections are those of ``functions.raster.PROJECTIONS``. Target centres go back to degrees, on to the source's plane, and
    meet its cells in one equi-join; cells outside the source or the projection have no value.
    """
    lon, lat = PROJECTIONS[to].inverse(F.col("x"), F.col("y"))
    x, y = PROJECTIONS[of].forward(F.col("lon"), F.col("lat"))
    at = cells_of(raster.sparkSession, target).select("row", "col", lon.alias("lon"), lat.alias("lat")).select("row", "col", x.alias("x"), y.alias("y"))
    sr, sc = cell_index(F.col("x"), F.col("y"), source)
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & ~F.isnan("x") & ~F.isnan("y")
    at = at.select("row", "col", *[F.when(finite, F.col(c)).alias(c) for c in ("x", "y")]).select("row", "col", sr.alias("sr"), sc.alias("sc"))
    cells = raster.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "z")
    return at.join(cells, ["sr", "sc"], "left").select("row", "col", "z")


def reproject_mercator(raster: DataFrame, source: Spec, target: Spec) -> DataFrame:
    """A raster in degrees to Mercator metres."""
    return reproject(raster, source, target, "degrees", "mercator")


def cube_of_layers(layers: DataFrame, catalog: DataFrame, nrows: int) -> DataFrame:
    """(i, j, k, v) from layers (name, row, col, z), rows counted from the top: columns become i, flipped rows j, layers in the order of depth k."""
    depths = catalog.select("name", (F.dense_rank().over(W.orderBy("depth_m")) - 1).alias("k"))  # a row per layer
    return layers.join(F.broadcast(depths), "name").select(F.col("col").alias("i"), (F.lit(nrows - 1) - F.col("row")).cast("int").alias("j"), "k", F.col("z").alias("v"))
