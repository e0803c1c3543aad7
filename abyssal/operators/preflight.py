"""Checks before a run, and remedies. A check is a row (check, status, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def describe(raster: DataFrame) -> DataFrame:
    """(nrows, ncols, n_cells, n_null, minimum, maximum) of a raster."""
    return raster.agg(
        (F.max("row") - F.min("row") + 1).alias("nrows"), (F.max("col") - F.min("col") + 1).alias("ncols"),
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("z").isNull()).alias("n_null"), F.min("z").alias("minimum"), F.max("z").alias("maximum"),
    )


def depth_coverage(axis: DataFrame, depths: DataFrame, z_col: str = "z", d_col: str = "d") -> DataFrame:
    """(env_min, env_max, bathy_min, bathy_max, top, bottom): how the layers' range lies against the bathymetry's."""
    e = axis.agg(F.min(z_col).alias("env_min"), F.max(z_col).alias("env_max"))
    b = depths.agg(F.min(d_col).alias("bathy_min"), F.max(d_col).alias("bathy_max"))
    word = lambda a, c: F.when(F.col(a) < F.col(c), "lower").when(F.col(a) == F.col(c), "equal").otherwise("greater")
    return e.crossJoin(F.broadcast(b)).withColumns({"top": word("env_min", "bathy_min"), "bottom": word("env_max", "bathy_max")})  # one row each


def depth_extend(layers: DataFrame, bathy_min: float, bathy_max: float) -> DataFrame:
    """layers (depth, i, j, v) with copies of the top and bottom layers where the bathymetry reaches beyond them.

    Above: at 0 where the bathymetry begins at 0, else one above its least depth. Below: one below the deepest layer,
    and 100 below the rounded greatest depth.
    """
    ends = layers.agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    top = F.when(F.col("lo") > bathy_min, F.array(F.lit(max(bathy_min - 1, 0.0)).cast("double")))
    below = F.when(F.col("hi") < bathy_max, F.array((F.col("hi") + 1).cast("double"), F.lit(float(round(bathy_max) + 100))))
    none = F.array().cast("array<double>")
    ends = ends.select("lo", "hi", F.coalesce(top, none).alias("up"), F.coalesce(below, none).alias("down"))
    at = layers.crossJoin(F.broadcast(ends))  # one row
    more = F.concat(F.array(F.col("depth").cast("double")), F.when(F.col("depth") == F.col("lo"), F.col("up")).otherwise(none), F.when(F.col("depth") == F.col("hi"), F.col("down")).otherwise(none))
    return at.select(F.explode(more).alias("depth"), "i", "j", "v")


def checks(meta: DataFrame) -> DataFrame:
    """meta (name, cs_type, cs_name, xy_units, cell_x, cell_y, xmin, ymin, xmax, ymax, bathy_cs, bxmin, bymin, bxmax, bymax) -> rows of checks.

    The environment must cover the bathymetry and one cell more.
    """
    ok = lambda c: F.when(c, "pass").otherwise("fail")
    row = lambda n, c, d: F.struct(F.lit(n).alias("check"), ok(c).alias("status"), d.cast("string").alias("detail"))
    c: dict[str, Column] = {x: F.col(x) for x in meta.columns}
    covers = (c["xmin"] <= c["bxmin"] - c["cell_x"]) & (c["ymin"] <= c["bymin"] - c["cell_y"]) & (c["xmax"] >= c["bxmax"] + c["cell_x"]) & (c["ymax"] >= c["bymax"] + c["cell_y"])
    rows = F.array(
        row("projected", c["cs_type"] == "Projected", c["cs_type"]), row("same projection", c["cs_name"] == c["bathy_cs"], c["cs_name"]), row("metres", c["xy_units"] == "Meter", c["xy_units"]),
        row("square cells", c["cell_x"] == c["cell_y"], c["cell_x"]), row("valid extent", (c["xmin"] < c["xmax"]) & (c["ymin"] < c["ymax"]), c["xmin"]), row("covers", covers, c["xmin"]),
    )
    return meta.select("name", F.explode(rows).alias("r")).select("name", "r.*")


def require(checked: DataFrame) -> None:
    if bad := checked.where("status = 'fail'").limit(20).collect():  # a message of bounded length
        raise ValueError("; ".join(f"{r.name}: {r.check} ({r.detail})" for r in bad))
