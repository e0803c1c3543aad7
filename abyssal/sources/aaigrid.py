"""ASCII grids and space-separated point files, by Spark's text and CSV readers and writers.

A grid is its header, pairs of a key and a number, and then nrows times ncols numbers from the top left, however they are
broken into lines. It is read as tokens: blocks of a file count theirs, a prefix over blocks numbers all tokens, and row and
column follow from the number. So one large file is many tasks, wherever it is cut, also inside a line or the header.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abyssal.session import ship_code, written
from abyssal.sources import splits

_HEAD = 12  # tokens of six pairs


def _joined(values: pa.Array) -> str:
    """All records with a space between them."""
    one = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(pa.string()))
    return pc.binary_join(one, " ")[0].as_py()


def _number(token: str) -> float:
    try:
        return float(token)
    except ValueError:
        return np.nan


def _numbers(text: str) -> np.ndarray:
    """The tokens of a text as numbers, NaN where one is none."""
    with warnings.catch_warnings():
        warnings.simplefilter("error", DeprecationWarning)
        try:
            return np.fromstring(text, sep=" ") if text.strip() else np.zeros(0)
        except (DeprecationWarning, ValueError):
            return np.array([_number(t) for t in text.split()], float)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, tokens of the block, its first tokens)."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        for file, start, values in splits.by_block(batch):
            own = found.setdefault((file, start), [0, []])
            text = _joined(values)
            if len(own[1]) < _HEAD:
                own[1] += text.split(None, _HEAD)[: _HEAD - len(own[1])]
            own[0] += len(text.split())
    keys = list(found)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1] for k in keys], pa.list_(pa.string()))], names=["file", "start", "n", "head"])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, number of the token in its block, value)."""
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        for file, start, values in splits.by_block(batch):
            x = _numbers(_joined(values))
            at = seen.get((file, start), 0)
            seen[file, start] = at + len(x)
            for a in range(0, len(x), 100_000):
                part = x[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), file)), pa.array(np.full(len(part), start)), pa.array(np.arange(at + a, at + a + len(part))), pa.array(part, from_pandas=True)], names=["file", "start", "i", "v"])


def read_grids(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(path, row, col, x, y, z) of all ASCII grids under ``path``, NODATA as NULL.

    With ``parts`` a folder is one grid, its files in the order of their names, as ``write_grid`` leaves them. Keys in any
    case; xllcenter and yllcenter are centres; without NODATA_value it is -9999. A token that is no number is NULL, values
    beyond nrows * ncols are left out, missing ones are absent, and so is a grid without ncols, nrows, origin or cellsize.
    """
    ship_code(spark)
    tokens = splits.records(spark, path, " ")
    counted = tokens.mapInArrow(_count, "file long, start long, n long, head array<string>").join(splits.files(spark, path), "file")
    grid = F.regexp_extract("path", "^(.*)/[^/]*$", 1) if parts else F.col("path")
    order = W.partitionBy("grid").orderBy("path", "start").rowsBetween(W.unboundedPreceding, -1)  # a row per block
    blocks = written(counted.withColumn("grid", grid).withColumn("from", F.coalesce(F.sum("n").over(order), F.lit(0))), "grid_blocks")
    first = blocks.select("grid", "from", F.posexplode("head").alias("o", "t")).select("grid", (F.col("from") + F.col("o")).alias("i"), "t").where(F.col("i") < _HEAD)
    heads = first.groupBy("grid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda e: e["t"]).alias("t"))  # 12 tokens
    pairs = F.when(F.get("t", F.lit(10)).rlike("^[A-Za-z]"), 6).otherwise(5)
    heads = heads.withColumn("h", pairs).withColumn("m", F.map_from_entries(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: F.struct(F.coalesce(F.lower(F.get("t", 2 * k)), k.cast("string")), F.get("t", 2 * k + 1)))))
    of = lambda n: F.try_element_at("m", F.lit(n)).try_cast("double")
    cell = of("cellsize")
    left, low = F.coalesce(of("xllcorner") + cell / 2, of("xllcenter")), F.coalesce(of("yllcorner") + cell / 2, of("yllcenter"))
    heads = heads.select("grid", (2 * F.col("h")).alias("skip"), of("ncols").cast("long").alias("nc"), of("nrows").cast("long").alias("nr"), left.alias("x0"), low.alias("y0"), cell.alias("cell"), F.coalesce(of("nodata_value"), F.lit(-9999.0)).alias("nodata"))
    heads = heads.where("nc > 0 and nr > 0 and x0 is not null and y0 is not null")
    at = splits.within_bound(written(blocks.select("file", "start", "from", "grid").join(heads, "grid"), "grid_heads"))
    cells = tokens.mapInArrow(_values, "file long, start long, i long, v double").join(at, ["file", "start"])
    cells = cells.withColumn("i", F.col("from") + F.col("i") - F.col("skip")).where((F.col("i") >= 0) & (F.col("i") < F.col("nc") * F.col("nr")))
    row, col = F.expr("i div nc"), F.col("i") % F.col("nc")
    return cells.select(F.col("grid").alias("path"), row.cast("int").alias("row"), col.cast("int").alias("col"), (F.col("x0") + F.col("cell") * col).alias("x"), (F.col("y0") + F.col("cell") * (F.col("nr") - 1 - row)).alias("y"), F.when(F.col("v") != F.col("nodata"), F.col("v")).alias("z"))


def grid_lines(raster: DataFrame, nodata: float = -9999.0, key: str = "tile_id") -> DataFrame:
    """(key, row, line): the body of an ASCII grid, a line per row, in column order."""
    cells = raster.groupBy(key, "row").agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce("z", F.lit(nodata)).alias("z")))).alias("c"))
    return cells.select(key, "row", F.concat_ws(" ", F.transform("c", lambda c: c["z"].cast("string"))).alias("line"))


def whole_lines(raster: DataFrame, nrows: int, ncols: int, nodata: float = -9999.0) -> DataFrame:
    """(row, line) for every row of a grid of this shape: cells and rows that are absent get NODATA, cells outside are left out."""
    none = f"{nodata} "
    cells = raster.where(F.col("row").between(0, nrows - 1) & F.col("col").between(0, ncols - 1))
    cells = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce("z", F.lit(nodata)).alias("z")))).alias("c"))
    gap = lambda c, i: c["col"] - F.coalesce(F.get(F.col("c"), i - 1)["col"], F.lit(-1)) - 1
    body = F.concat_ws(" ", F.transform("c", lambda c, i: F.concat(F.repeat(F.lit(none), gap(c, i).cast("int")), c["z"].cast("string"))))
    tail = F.repeat(F.lit(" " + none.strip()), (F.lit(ncols - 1) - F.element_at("c", -1)["col"]).cast("int"))
    filled = cells.select("row", F.concat(body, tail).alias("line"))
    rows = raster.sparkSession.range(nrows).select(F.col("id").cast("int").alias("row"))
    return rows.join(filled, "row", "left").select("row", F.coalesce("line", F.lit((none * ncols).strip())).alias("line"))


def _header(ncols: int, nrows: int, xll: float, yll: float, cell: float, nodata: float) -> list[str]:
    return [f"ncols {ncols}", f"nrows {nrows}", f"xllcorner {xll}", f"yllcorner {yll}", f"cellsize {cell}", f"NODATA_value {nodata}"]


def write_grid(raster: DataFrame, path: str, nrows: int, ncols: int, xll: float = 0.0, yll: float = 0.0, cell: float = 1.0, nodata: float = -9999.0, parts: int = 8) -> None:
    """One grid (row, col, z) as a folder of part files, its rows dealt in order: one after another they are the grid's file."""
    spark = raster.sparkSession
    head = spark.createDataFrame(list(enumerate(_header(ncols, nrows, float(xll), float(yll), float(cell), nodata), -6)), "row int, line string")
    lines = whole_lines(raster, nrows, ncols, nodata).union(head)
    each = -(-nrows // max(parts, 1))
    part = F.greatest(F.floor(F.col("row") / each), F.lit(0)).cast("int")
    lines.repartitionById(max(parts, 1), part).sortWithinPartitions("row").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_grids(raster: DataFrame, path: str, cell: float = 1.0, nodata: float = -9999.0, key: str = "tile_id") -> None:
    """One text file per tile under path/key=..: six header lines, then the rows from the top. A tile's lines sort in one task."""
    size = raster.groupBy(key).agg(F.min("row").alias("r0"), (F.max("row") - F.min("row") + 1).alias("nr"), (F.max("col") - F.min("col") + 1).alias("nc"), F.min("col").alias("c0"))
    part = lambda n, v: F.concat(F.lit(f"{n} "), v.cast("string"))
    head = F.array(part("ncols", F.col("nc")), part("nrows", F.col("nr")), part("xllcorner", F.col("c0") * F.lit(cell)), part("yllcorner", F.lit(0.0)), part("cellsize", F.lit(cell)), part("NODATA_value", F.lit(nodata)))
    heads = size.select(key, F.posexplode(head).alias("o", "line")).select(key, (F.col("o") - 6).alias("row"), "line")
    lines = grid_lines(raster, nodata, key).select(key, "row", "line").unionByName(heads)
    # repartition by tile: a tile is bounded by its side limit
    lines.repartition(key).sortWithinPartitions(key, "row").select(key, F.col("line").alias("value")).write.partitionBy(key).mode("overwrite").text(path)


def read_yxz(spark: SparkSession, path: str, nodata: float = 349000000.0) -> DataFrame:
    points = spark.read.schema("y double, x double, z double").option("sep", " ").csv(path)
    return points.withColumn("z", F.when(F.col("z") != nodata, F.col("z")))


def write_yxz(points: DataFrame, path: str, nodata: float = 349000000.0) -> None:
    points.select("y", "x", F.coalesce("z", F.lit(nodata)).alias("z")).write.option("sep", " ").mode("overwrite").csv(path)
