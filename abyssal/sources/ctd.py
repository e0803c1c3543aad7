"""Directories of cast files: parallel scan of files of any size, cleaned casts as CSV out and in again.

A cast opens with a '#--' line; its header has CAST, Latitude, Longitude and VARIABLES up to Prof-Flag; levels follow up to
END. What a line means depends on the lines before it: on the phase of the cast, on its header and on the number of casts.
A block of a file is therefore read for every phase that it may begin in, as long as no cast opens in it; its summary maps
that phase to the one at its end, with the header fields it sets. These maps are composed over a file's blocks, a row each, and
each level then takes what its block began with. So a file may be cut anywhere, also inside a header or a profile.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abyssal.functions.raster import number
from abyssal.operators import casts
from abyssal.session import ship_code, written
from abyssal.sources import splits

NONE, HEAD, DATA, ENDED = range(4)
_FIELDS = {"CAST": 0, "Latitude": 1, "Longitude": 2}
_NAMES = 3


class Machine:
    """The phase and header of the cast at some line, for one phase at the block's begin."""

    def __init__(self, phase: int):
        self.phase, self.known, self.values = phase, 0, [None, None, None, None]

    def opened(self) -> None:
        self.phase, self.known, self.values = HEAD, 15, [None, None, None, None]

    def step(self, fields: list[str]) -> bool:
        """Whether the line is a level."""
        key = fields[0]
        if self.phase == HEAD:
            if key in _FIELDS or key == "VARIABLES":
                at = _FIELDS.get(key, _NAMES)
                self.known |= 1 << at
                self.values[at] = fields if at == _NAMES else fields[2] if len(fields) > 2 else None
            elif key == "Prof-Flag":
                self.phase = DATA
            elif key.startswith("END"):
                self.phase = ENDED
        elif self.phase == DATA:
            if key.startswith("END"):
                self.phase = ENDED
            else:
                return True
        return False


class Block:
    """A block as far as it is read: casts opened in it, and a machine per phase of its begin, or one once a cast opened."""

    def __init__(self):
        self.casts, self.machines = 0, [Machine(p) for p in range(4)]

    def line(self, line: str) -> Iterator[tuple[int, Machine, list[str]]]:
        """(mask of the phases at the begin for which this is a level, the machine, the fields)."""
        if line.startswith("#--"):
            self.casts += 1
            self.machines = [Machine(NONE)]
            self.machines[0].opened()
        elif line:
            fields = [x.strip(" ") for x in line.split(",")]
            for i, m in enumerate(self.machines):
                if m.step(fields):
                    yield (15 if self.casts else 1 << i), m, fields


def _lines(values: pa.Array) -> Iterator[str]:
    return (v.rstrip("\r") for v in values.to_pylist() if v is not None)


_TEXTS = pa.list_(pa.string())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, casts, and for each phase at the begin: phase at the end, known fields, their values)."""
    blocks: dict[tuple[int, int], Block] = {}
    for batch in batches:
        for file, start, values in splits.by_block(batch):
            b = blocks.setdefault((file, start), Block())
            for line in _lines(values):
                for _ in b.line(line):
                    pass
    rows = []
    for (file, start), b in blocks.items():
        for i in range(4):
            m = b.machines[0 if b.casts else i]
            rows.append((file, start, b.casts, i, m.phase, m.known, *m.values))
    columns = list(zip(*rows)) or [()] * 10
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), _TEXTS]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "casts", "begins", "ends", "known", "cast", "lat", "lon", "names"])


def _composed(table: pa.Table) -> pa.Table:
    """Blocks of one file -> what each begins with: casts before it, phase, header."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["start"], r["begins"]))
    total, phase, values = 0, NONE, [None] * 4
    out = []
    for i in range(0, len(rows), 4):
        here = rows[i + phase]
        out.append((here["file"], here["start"], total, phase, *values))
        total += here["casts"]
        phase = here["ends"]
        values = [here[c] if here["known"] >> j & 1 else old for j, (c, old) in enumerate(zip(("cast", "lat", "lon", "names"), values))]
    columns = list(zip(*out)) or [()] * 8
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), _TEXTS]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "before", "phase", "cast0", "lat0", "lon0", "names0"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, cast of the block, mask, known, cast, lat, lon, names, fields) of all lines that may be levels."""
    blocks: dict[tuple[int, int], Block] = {}
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), _TEXTS, _TEXTS]
    for batch in batches:
        rows = []
        for file, start, values in splits.by_block(batch):
            b = blocks.setdefault((file, start), Block())
            for line in _lines(values):
                for mask, m, fields in b.line(line):
                    rows.append((file, start, b.casts, mask, m.known, *m.values, fields))
        columns = list(zip(*rows)) or [()] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "own", "mask", "known", "cast", "lat", "lon", "names", "fields"])


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(levels, files): levels (path, cast_no, cast, lat, lon, level, names, fields) of all cast files, a row per level, and (path, n_casts).

    As ``casts.parse`` has them of whole texts. Casts of a file are numbered from 1 by their '#--' lines; a cast without END
    ends with its file or the next cast; lines outside profiles, empty ones and header lines after Prof-Flag are no levels.
    """
    ship_code(spark)
    lines = splits.records(spark, path)
    kind = "cast string, lat string, lon string, names array<string>"
    summed = written(lines.mapInArrow(_summaries, f"file long, start long, casts long, begins int, ends int, known int, {kind}"), "cast_blocks")
    # a file's blocks are some hundred bytes for each maxPartitionBytes of it
    begins = summed.groupBy("file").applyInArrow(_composed, "file long, start long, before long, phase int, cast0 string, lat0 string, lon0 string, names0 array<string>")
    names = splits.files(spark, path)
    begins = splits.within_bound(written(begins.join(names, "file"), "cast_begins"))
    rows = lines.mapInArrow(_levels, f"file long, start long, own long, mask int, known int, {kind}, fields array<string>").join(begins, ["file", "start"])
    rows = rows.where(F.expr("shiftright(mask, phase) & 1 = 1"))
    of = lambda c, bit: F.when((F.col("own") > 0) | (F.col("known").bitwiseAND(1 << bit) > 0), F.col(c)).otherwise(F.col(f"{c}0"))
    levels = rows.select("path", (F.col("before") + F.col("own")).alias("cast_no"), of("cast", 0).alias("cast"), number(of("lat", 1)).alias("lat"), number(of("lon", 2)).alias("lon"), number(F.col("fields")[0]).cast("int").alias("level"), of("names", 3).alias("names"), "fields")
    counts = summed.where("begins = 0").groupBy("file").agg(F.sum("casts").alias("n_casts")).join(names, "file").select("path", "n_casts")
    return levels, counts


def cleaned(levels: DataFrame, counts: DataFrame, names: list[str], depth: str = "Depth") -> tuple[DataFrame, DataFrame]:
    """The casts of ``scan`` with the named variables, and (n_casts, n_failed).

    A cast, known by its file and number, is its deepest level; of a file's casts at one place the deepest stays, the first
    of equals; depths turn negative. A cast without any level with a value of the first variable has failed.
    """
    get = lambda n: F.when(F.array_position("names", n) > 0, F.get("fields", (F.array_position("names", n) - 1).cast("int"))).alias(n)
    rows = casts.coerce(levels.select("path", "cast_no", "cast", "lat", "lon", "level", *[get(n) for n in names]), names)
    rest = [c for c in rows.columns if c not in ("path", "cast_no")]
    good = rows.where(F.col(names[0]).isNotNull()).groupBy("path", "cast_no").agg(F.max_by(F.struct(*rest), "level").alias("r")).select("path", "cast_no", "r.*")
    good = written(good, "deepest")
    if depth in names:
        good = good.withColumn(depth, -F.col(depth))
        others = [c for c in good.columns if c not in ("path", "lat", "lon")]
        done = good.groupBy("path", "lat", "lon").agg(F.min_by(F.struct(*others), F.struct(F.col(depth), F.col("cast_no"))).alias("r")).select("path", "lat", "lon", "r.*")
    else:
        done = good
    total = counts.agg(F.coalesce(F.sum("n_casts"), F.lit(0)).alias("n_casts")).crossJoin(good.agg(F.count(F.lit(1)).alias("n_good")))  # one row each
    return done.select(*good.columns), total.select("n_casts", (F.col("n_casts") - F.col("n_good")).alias("n_failed"))


def write_casts(done: DataFrame, path: str) -> None:
    done.write.option("header", True).mode("overwrite").csv(path)


def read_casts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
