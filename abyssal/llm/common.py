"""Shared plumbing of the training-data operators: reading, cutting lineage, shipping code."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abyssal.session import ship_code

#: White space that separates words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, the warehouse, or a folder of our own if Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="abyssal-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a Parquet table in the shared folder and read it back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/abyssal-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(written: DataFrame) -> None:
    """Remove what ``materialise`` wrote, once nothing reads it any more."""
    sc = written.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(written._written_to)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def carried(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """The row's own columns as one struct, so that no name of ours meets one of theirs."""
    names = [c for c in df.columns if c not in but]
    return F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("none"))


def tidy(run):
    """A task's function that gives memory back when it ends: Python workers stay, and hold what they once needed."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return inner


#: What a batch of rows sent to a Python worker holds at most, where the user has not said otherwise: texts may be long.
_BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def ship(spark: SparkSession) -> None:
    """Make ready for Python workers: smaller batches where Spark's own setting holds, and this package importable where they do not see the repository."""
    for key, (usual, ours) in _BATCH_SETTINGS.items():
        if spark.conf.get(key, None) == usual:
            spark.conf.set(key, ours)
    ship_code(spark)


def small_or_plain(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast hint only when the counted rows are within the bound; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= most else df
