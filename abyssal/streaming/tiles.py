"""Tiles that arrive as files: each is interpolated once, with the same transformation as in batch, and committed with its batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abyssal.operators.grid import Grid
from abyssal.operators.interpolation import tile_flags, trilinear
from abyssal.operators.tiling import edge_tiles, pending

# What a failed tile's points have.
FAILED_VALUE, FAILED_FLAG = 100000.0, "Flag 5"


def interpolate_stream(spark: SparkSession, points_dir: str, schema: str, cube: DataFrame, grid: Grid, out_dir: str, state_dir: str, bounds: str = "null"):
    """Start a run over the files not seen before; it ends when they are done. No state: the map side only."""
    points = spark.readStream.schema(schema).parquet(points_dir)
    done = trilinear(points, cube, grid, bounds)
    return done.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", state_dir).trigger(availableNow=True).start()


def interpolated(points: DataFrame, cube: DataFrame, grid: Grid, edges: str = "clamp") -> DataFrame:
    """points (x, y, d, tile_id) with tri and flag: what a run makes of tiles.

    A tile with points outside the grid is moved onto it ('clamp'), or fails as a whole ('fail'): all its points have the
    value and flag of failure. A point without a depth has no value.
    """
    at_edge = edge_tiles(points, grid.extent)
    done = trilinear(tile_flags(points, at_edge, grid), cube, grid, "clamp")
    if edges == "clamp":
        return done
    failed = at_edge.select(F.col("tile_id").alias("_t"), "edge").where("edge").select("_t")
    out = done.join(failed, F.col("tile_id") == F.col("_t"), "left")
    bad = F.col("_t").isNotNull()
    new = {"tri": F.when(bad, F.lit(FAILED_VALUE)).otherwise(F.col("tri")), "flag": F.when(bad, F.lit(FAILED_FLAG)).otherwise(F.col("flag"))}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in done.columns])


def manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """(tile_id, failed, n, epoch) of all finished tiles; none before the first commit."""
    try:
        return spark.read.parquet(f"{out_dir}/manifest")
    except AnalysisException as e:
        if (e.getCondition() or "") not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "tile_id long, failed boolean, n long, epoch int")


def _tiles_written(done: DataFrame, out_dir: str, epoch: int) -> DataFrame:
    path = f"{out_dir}/tiles/epoch={epoch}"
    done.write.mode("overwrite").parquet(path)
    return done.sparkSession.read.parquet(path)


def _committed(written: DataFrame, out_dir: str, epoch: int) -> None:
    """The batch's manifest, after its tiles: its presence is the commit."""
    rows = written.groupBy(F.col("tile_id").cast("long").alias("tile_id")).agg(F.max(F.col("flag") == FAILED_FLAG).alias("failed"), F.count(F.lit(1)).alias("n"))
    rows.write.mode("overwrite").parquet(f"{out_dir}/manifest/epoch={epoch}")


def run_tiles(spark: SparkSession, points_dir: str, schema: str, cube: DataFrame, grid: Grid, out_dir: str, state_dir: str, edges: str = "clamp", files: int = 1000):
    """Start a run over the tile files not seen before, ``files`` a batch; a tile comes whole in one file.

    Each batch writes its tiles, then its manifest, both by the batch's number, so a batch that is tried again after a break
    replaces what it left. Tiles that an earlier batch has finished are skipped, also when they are delivered again.
    """
    points = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(points_dir)

    def batch(rows: DataFrame, epoch: int) -> None:
        finished = manifest(spark, out_dir).where(F.col("epoch") != epoch).select("tile_id")
        _committed(_tiles_written(interpolated(pending(rows, finished), cube, grid, edges), out_dir, epoch), out_dir, epoch)

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", state_dir).trigger(availableNow=True).start()


def results(spark: SparkSession, out_dir: str) -> DataFrame:
    """The points of all committed tiles; what a broken batch wrote does not show."""
    commits = manifest(spark, out_dir).select(F.col("epoch").alias("_epoch")).distinct()
    rows = spark.read.parquet(f"{out_dir}/tiles")
    return rows.join(commits, F.col("epoch") == F.col("_epoch"), "left_semi").drop("epoch")
