"""Text files read in parallel: numbered blocks of a file, so that what needs an order is put together from their summaries.

Spark cuts files at ``spark.sql.files.maxPartitionBytes``, also inside a long line, at the next separator. A block is known by
its file and first byte; a task reads a block's records in order. Whatever counts or state a record needs from the blocks
before it is a prefix over a row per block, and is joined to what the block gave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks up to which their prefixes are broadcast; beyond it they are joined by a shuffle.
MOST_BLOCKS = 200_000


def _name(path: Column) -> Column:
    """A file's name without its scheme, which readers spell in several ways."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


def records(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, start, value): the records of all files under ``path``, file as the hash of its name, in order within a block."""
    reader = spark.read.option("recursiveFileLookup", "true")  # folders named like column=value are folders
    reader = reader if separator is None else reader.option("lineSep", separator)
    at = reader.text(path).select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("start"))
    plain = F.coalesce(F.try_url_decode(F.replace("p", F.lit("+"), F.lit("%2B"))), "p")  # the text reader's names are escaped
    return at.select(F.xxhash64(_name(plain)).alias("file"), "start", "value")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, path), a row per file; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.xxhash64(_name(F.col("path"))).alias("file"), "path")


def within_bound(blocks: DataFrame) -> DataFrame:
    """Blocks (a written table) with a broadcast hint where their number is within the bound."""
    return F.broadcast(blocks) if blocks.count() <= MOST_BLOCKS else blocks


def by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    """(file, start, records) of each block that has records in the batch, in order."""
    file, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    if not len(file):
        return
    cuts = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (start[1:] != start[:-1])])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(file)]):
        yield int(file[a]), int(start[a]), batch.column(2).slice(a, b - a)
