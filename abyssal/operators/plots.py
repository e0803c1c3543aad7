"""Plots as pixel bins: points are counted on a raster of fixed size, and only that raster reaches the driver."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scatter_pixels(points: DataFrame, x: str, y: str, size: int = 200, limits: tuple[float, float] | None = None) -> DataFrame:
    """(px, py, n): the number of points in each pixel of a square plot with the same limits on both axes, py from the bottom.

    Limits are the least and greatest of both columns, or given; points outside these, or without a coordinate, are left
    out. If all are equal they lie in pixel 0. One pass for the limits, one aggregation.
    """
    at = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    if limits is None:
        span = at.agg(F.least(F.min("x"), F.min("y")).alias("lo"), F.greatest(F.max("x"), F.max("y")).alias("hi"))
    else:
        span = points.sparkSession.createDataFrame([tuple(map(float, limits))], "lo double, hi double")
    at = at.crossJoin(F.broadcast(span)).where("x between lo and hi and y between lo and hi")  # one row
    pixel = lambda c: F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo")) * size), F.lit(size - 1))).otherwise(F.lit(0)).cast("int")
    return at.groupBy(pixel("x").alias("px"), pixel("y").alias("py")).agg(F.count(F.lit(1)).alias("n"))


def raster_pixels(raster: DataFrame, nrows: int, ncols: int, size: int = 200) -> DataFrame:
    """(px, py, z): the mean of a raster's values in each pixel of an overview, py from the bottom; pixels without a value are absent."""
    each = max(1, -(-max(nrows, ncols) // size))
    at = raster.where("z is not null and not isnan(z)").select(F.expr(f"cast(col div {each} as int)").alias("px"), F.expr(f"cast(({nrows - 1} - row) div {each} as int)").alias("py"), "z")
    return at.groupBy("px", "py").agg(F.avg("z").alias("z"))


def png(pixels: list[tuple[int, int, float]], width: int, height: int) -> bytes:
    """A grey picture: white where there is nothing, darker for higher values; pixels are (px, py from the bottom, value)."""
    values = [v for _, _, v in pixels]
    low, span = min(values, default=0.0), (max(values, default=0.0) - min(values, default=0.0)) or 1.0
    rows = [bytearray(b"\xff" * width) for _ in range(height)]
    for px, py, v in pixels:
        if 0 <= px < width and 0 <= py < height:
            rows[height - 1 - py][px] = 200 - round(200 * (v - low) / span)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")


def save_png(pixels: DataFrame, path: str, width: int = 200, height: int = 200) -> None:
    """The picture of ``scatter_pixels`` or ``raster_pixels`` as a file, on whatever file system Spark writes to."""
    data = png([tuple(r) for r in pixels.select(*pixels.columns[:3]).collect()], width, height)  # a row per pixel
    sc = pixels.sparkSession.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
