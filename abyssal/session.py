"""Session defaults."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def session(name: str = "abyssal", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI mode stays on."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable by Python workers that do not see the repository on their path."""
    on_path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if any(Path(p).resolve() == _ROOT for p in on_path):
        return
    sc = spark.sparkContext
    if getattr(sc, "_abyssal_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="abyssal-")) / "abyssal_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in (_ROOT / "abyssal").rglob("*.py"):
            z.write(f, f.relative_to(_ROOT))
    sc.addPyFile(str(out))
    sc._abyssal_shipped = True


_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir; where it is unset the warehouse, or a folder of our own if Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="abyssal-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    return f"{base.rstrip('/')}/abyssal-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: a Parquet table in the shared folder, read back. It survives lost executors, and is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
