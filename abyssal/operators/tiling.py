"""Tiles and mosaics of rasters (row, col, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_count(n: int, trigger: int = 999, most: int = 2000) -> int:
    """Tiles along a side of n cells: two more for each halving down to the trigger, doubled, then doubled until a tile has ``most`` cells at most."""
    total, left = 1, n
    while left >= trigger:
        left //= 2
        total += 2
    total *= 2
    while n / total > most:
        total *= 2
    return total


def is_small(nrows: int, ncols: int, trigger: int = 999) -> bool:
    return nrows < trigger and ncols < trigger


def tile_assign(raster: DataFrame, nrows: int, ncols: int, nx: int, ny: int) -> DataFrame:
    """raster with tile_id = xi * ny + yi, counted from the left and the bottom."""
    w, h = -(-ncols // nx), -(-nrows // ny)
    xi = F.floor(F.col("col") / w)
    yi = F.floor((F.lit(nrows - 1) - F.col("row")) / h)
    return raster.withColumn("tile_id", (xi * ny + yi).cast("int"))


def tile_index(tiles: DataFrame) -> DataFrame:
    """(tile_id, name, rmin, rmax, cmin, cmax) of the tiles' cells."""
    bounds = tiles.groupBy("tile_id").agg(F.min("row").alias("rmin"), F.max("row").alias("rmax"), F.min("col").alias("cmin"), F.max("col").alias("cmax"))
    return bounds.withColumn("name", F.concat(F.lit("sp"), F.col("tile_id").cast("string")))


def tile_classify(tiles: DataFrame) -> DataFrame:
    """(tile_id, n, n_good, zmin, zmax, status): null without a value, fail where the least equals the greatest, else pass."""
    stats = tiles.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("n_good"), F.min("z").alias("zmin"), F.max("z").alias("zmax"))
    return stats.withColumn("status", F.when(F.col("n_good") == 0, "null").when(F.col("zmin") == F.col("zmax"), "fail").otherwise("pass"))


def valid_tiles(tiles: DataFrame, classified: DataFrame) -> DataFrame:
    return tiles.join(classified.where(F.col("status") == "pass"), "tile_id", "left_semi")


def pending(tiles: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tiles without a finished output."""
    return tiles.join(manifest, "tile_id", "left_anti")


def mirror(raster: DataFrame, ncols: int) -> DataFrame:
    return raster.withColumn("col", (F.lit(ncols - 1) - F.col("col")).cast("int"))


def mosaic(rasters: list[DataFrame], how: str = "first") -> DataFrame:
    """One raster of several. Where they overlap: the first or last value that is not NULL, or the mean of all."""
    parts = [r.select("row", "col", "z", F.lit(i).alias("prio")) for i, r in enumerate(rasters)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    prio = F.when(F.col("z").isNotNull(), F.col("prio"))
    value = {"mean": F.avg("z"), "first": F.min_by("z", prio), "last": F.max_by("z", prio)}[how]
    return out.groupBy("row", "col").agg(value.alias("z"))


def shift(raster: DataFrame, rows: int, cols: int) -> DataFrame:
    return raster.withColumns({"row": (F.col("row") + rows).cast("int"), "col": (F.col("col") + cols).cast("int")})


def shift_pad(raster: DataFrame, by: int = 3) -> DataFrame:
    """Edges widened by diagonal copies: the raster itself first, then left up, left down, right down, right up."""
    return mosaic([raster, *(shift(raster, dr, dc) for dr, dc in ((-by, -by), (by, -by), (by, by), (-by, by)))], "first")


def edge_tiles(points: DataFrame, extent: tuple[float, float, float, float], tile: str = "tile_id") -> DataFrame:
    """(tile, edge): whether any of a tile's points lies outside (xmin, ymin, xmax, ymax)."""
    xmin, ymin, xmax, ymax = extent
    out = (F.min("x") < xmin) | (F.max("x") > xmax) | (F.min("y") < ymin) | (F.max("y") > ymax)
    return points.groupBy(tile).agg(out.alias("edge"))


def template_tile(classified: DataFrame) -> DataFrame:
    """The first tile that passes, as the pattern of the others: one row."""
    return classified.where(F.col("status") == "pass").agg(F.min_by(F.struct(*classified.columns), "tile_id").alias("t")).select("t.*")
