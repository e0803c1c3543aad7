"""Tiles as GeoTIFF files, a file per tile: written and read by tasks, on whatever file system Spark uses.

A file is a classic TIFF of one band: its directory, and blocks (strips or tiles) that are found by their offsets, so a window
is read without unpacking the others. numpy and zlib suffice. A tile of a raster is bounded by its side limit, and so is a
file; the raster is the folder.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abyssal.session import ship_code

# The format's field types, as bytes and struct codes, and its tags.
_TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
_DEFLATE = (8, 32946)


def encode(z: np.ndarray, left: float, top: float, cell: float, nodata: float = -9999.0, side: int = 256) -> bytes:
    """A raster (rows from the top, NaN for nothing) as a tiled, deflated GeoTIFF of doubles."""
    nrows, ncols = z.shape
    filled = np.full((-(-nrows // side) * side, -(-ncols // side) * side), nodata)
    filled[:nrows, :ncols] = np.where(np.isnan(z), nodata, z)
    blocks = [zlib.compress(filled[r : r + side, c : c + side].astype("<f8").tobytes()) for r in range(0, filled.shape[0], side) for c in range(0, filled.shape[1], side)]
    text = f"{nodata}".encode() + b"\0"
    fields = [
        (WIDTH, 4, [ncols]), (LENGTH, 4, [nrows]), (BITS, 3, [64]), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (TILE_WIDTH, 3, [side]), (TILE_LENGTH, 3, [side]),
        (TILE_OFFSETS, 4, [0] * len(blocks)), (TILE_BYTES, 4, [len(b) for b in blocks]), (SAMPLE_FORMAT, 3, [3]), (PIXEL_SCALE, 12, [cell, cell, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, left, top, 0.0]),
        (GEO_KEYS, 3, [1, 1, 0, 1, 1025, 0, 1, 1]), (NODATA, 2, [text[i : i + 1] for i in range(len(text))]),
    ]
    start = 8 + 2 + 12 * len(fields) + 4
    size = lambda kind, values: _TYPES[kind][0] * len(values)
    at = start + sum((size(k, v) + 1) // 2 * 2 for _, k, v in fields if size(k, v) > 4)
    offsets = []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    directory, rest = struct.pack("<H", len(fields)), b""
    for tag, kind, values in fields:
        packed = struct.pack(f"<{len(values)}{_TYPES[kind][1]}", *(offsets if tag == TILE_OFFSETS else values))
        if len(packed) > 4:
            directory += struct.pack("<HHII", tag, kind, len(values), start + len(rest))
            rest += packed + b"\0" * (len(packed) % 2)
        else:
            directory += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + directory + struct.pack("<I", 0) + rest + b"".join(blocks)


class File:
    """The directory of a TIFF; None where the bytes are no classic TIFF of one plain band."""

    def __init__(self, data: bytes):
        self.data, self.order = data, {b"II": "<", b"MM": ">"}.get(data[:2], "")
        self.fields: dict[int, tuple] = {}
        try:
            if not self.order or struct.unpack(self.order + "H", data[2:4])[0] != 42:
                raise ValueError("not a classic TIFF")
            (at,) = struct.unpack(self.order + "I", data[4:8])
            (n,) = struct.unpack(self.order + "H", data[at : at + 2])
            for i in range(n):
                tag, kind, count = struct.unpack(self.order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
                if kind in _TYPES:
                    size = _TYPES[kind][0] * count
                    begin = at + 10 + 12 * i if size <= 4 else struct.unpack(self.order + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
                    self.fields[tag] = struct.unpack(f"{self.order}{count}{_TYPES[kind][1]}", data[begin : begin + size])
            one = lambda tag, usual: int(self.fields.get(tag, (usual,))[0])
            self.ncols, self.nrows = int(self.fields[WIDTH][0]), int(self.fields[LENGTH][0])
            if one(SAMPLES, 1) != 1 or one(PREDICTOR, 1) != 1 or one(COMPRESSION, 1) not in (1, *_DEFLATE):
                raise ValueError("not a plain band")
            self.packed = one(COMPRESSION, 1) != 1
            self.kind = np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[one(SAMPLE_FORMAT, 1)]}{one(BITS, 8) // 8}")
            tiled = TILE_OFFSETS in self.fields
            self.offsets, self.sizes = self.fields[TILE_OFFSETS if tiled else STRIP_OFFSETS], self.fields[TILE_BYTES if tiled else STRIP_BYTES]
            self.height, self.width = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, self.nrows), self.nrows), self.ncols)
            scale, tie = self.fields.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), self.fields.get(TIE_POINT, (0.0,) * 6)
            self.dx, self.dy = scale[0], scale[1]
            self.left, self.top = tie[3] - tie[0] * self.dx, tie[4] + tie[1] * self.dy
            self.nodata = float(b"".join(self.fields[NODATA]).split(b"\0")[0]) if NODATA in self.fields else None
            self.read = 0
        except (ValueError, KeyError, TypeError, struct.error) as e:
            raise ValueError(f"not a GeoTIFF that can be read: {e}") from e

    def blocks(self, window: tuple[int, int, int, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, cols, values) of each block that meets the window (row, col, nrows, ncols); NaN for NODATA. Others are not unpacked."""
        r0, c0, h, w = window or (0, 0, self.nrows, self.ncols)
        r1, c1 = min(r0 + h, self.nrows), min(c0 + w, self.ncols)
        across = -(-self.ncols // self.width)
        for i, (at, n) in enumerate(zip(self.offsets, self.sizes)):
            top, left = i // across * self.height, i % across * self.width
            a, b, c, d = max(top, r0), min(top + self.height, r1), max(left, c0), min(left + self.width, c1)
            if a >= b or c >= d:
                continue
            self.read += 1
            raw = self.data[at : at + n]
            flat = np.frombuffer(zlib.decompress(raw) if self.packed else raw, self.kind)
            block = flat[: len(flat) // self.width * self.width].reshape(-1, self.width)
            z = block[a - top : b - top, c - left : d - left].astype(float)
            if self.nodata is not None:
                z[z == self.nodata] = np.nan
            rows, cols = np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij")
            yield rows.reshape(-1), cols.reshape(-1), z.reshape(-1)


def write_tiles(tiles: DataFrame, path: str, left: float = 0.0, top: float = 0.0, cell: float = 1.0, nodata: float = -9999.0, key: str = "tile_id") -> None:
    """A GeoTIFF for each tile under path/key=.., from (key, row, col, z), rows and columns of the whole raster from its corner (left, top).

    A tile is the box of its cells; cells that are absent get NODATA, of cells that repeat the greatest value counts. Its bytes
    go through the text writer as they are, which leaves a line end after them that no reader looks at.
    """
    ship_code(tiles.sparkSession)
    kind = dict(tiles.dtypes)[key]

    def one(table: pa.Table) -> pa.Table:
        row, col = (table[c].to_numpy() for c in ("row", "col"))
        z = np.full((int(np.ptp(row)) + 1, int(np.ptp(col)) + 1), np.nan)
        z[row - row.min(), col - col.min()] = table["z"].to_numpy(zero_copy_only=False)
        data = encode(z, left + float(col.min()) * cell, top - float(row.min()) * cell, cell, nodata)
        return pa.table({"k": table["k"].slice(0, 1), "data": pa.array([data], pa.binary())})

    cells = tiles.where("row is not null and col is not null").groupBy(F.col(key).alias("k"), "row", "col").agg(F.max(F.col("z").cast("double")).alias("z"))
    files = cells.groupBy("k").applyInArrow(one, f"k {kind}, data binary")
    files.select(F.col("k").alias(key), F.col("data").cast("string").alias("value")).write.partitionBy(key).mode("overwrite").text(path)


def read_tiles(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, row, col, x, y, z) of all GeoTIFFs under ``path``, z NULL for NODATA; with ``window`` (row, col, nrows, ncols) of each only the blocks that it meets.

    Reads strips and tiles, plain or deflated, of whole numbers and floats in either byte order. A file that is none of these
    fails with its name.
    """
    ship_code(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    f = File(data)
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e
                for rows, cols, z in f.blocks(window):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(f.left + (cols + 0.5) * f.dx), pa.array(f.top - (rows + 0.5) * f.dy), pa.array(z, from_pandas=True)], names=["path", "row", "col", "x", "y", "z"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, "path string, row int, col int, x double, y double, z double")
