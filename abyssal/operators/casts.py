"""Depth-profile casts: parsing, cleaning, reduction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abyssal.functions.raster import MISSING_TEXT, number


def parse(files: DataFrame) -> DataFrame:
    """(path, text) of whole files -> (path, cast_no, cast, lat, lon, level, names, fields), a row per level.

    '#--' opens a cast; CAST, Latitude and Longitude carry their value in the third field; VARIABLES names the columns;
    Prof-Flag ends the header and END the levels. Casts of a file are numbered by a running sum over its lines.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("no", "line"))
    f = F.transform(F.split("line", ","), lambda x: F.trim(x))
    order = W.partitionBy("path").orderBy("no")
    lines = lines.withColumns({"f": f, "cast_no": F.sum(F.startswith(F.col("line"), F.lit("#--")).cast("int")).over(order)}).where("cast_no > 0")
    whole = W.partitionBy("path", "cast_no")
    key = F.col("f")[0]
    value = lambda name: F.max(F.when(key == name, F.col("f")[2])).over(whole)
    place = lambda test: F.min(F.when(test, F.col("no"))).over(whole)
    lines = lines.withColumns({
        "cast": value("CAST"), "lat": number(value("Latitude")), "lon": number(value("Longitude")),
        "names": F.max(F.when(key == "VARIABLES", F.col("f"))).over(whole), "from": place(key == "Prof-Flag"), "to": place(F.startswith(key, F.lit("END"))),
    })
    levels = lines.where((F.col("no") > F.col("from")) & (F.col("to").isNull() | (F.col("no") < F.col("to"))) & (F.col("line") != ""))
    return levels.select("path", "cast_no", "cast", "lat", "lon", number(key).cast("int").alias("level"), "names", F.col("f").alias("fields"))


def variables(parsed: DataFrame, names: list[str]) -> DataFrame:
    """The named variables of parsed levels as text columns; a variable that a file lacks is NULL."""
    get = lambda n: F.when(F.array_position("names", n) > 0, F.get("fields", (F.array_position("names", n) - 1).cast("int")))
    return parsed.select("cast", "lat", "lon", "level", *[get(n).alias(n) for n in names])


def variable_names(parsed: DataFrame) -> DataFrame:
    """The distinct variable names of all files."""
    return parsed.select(F.explode("names").alias("name")).where(~F.col("name").isin("VARIABLES", "F", "O", "")).distinct()


def coerce(casts: DataFrame, columns: list[str]) -> DataFrame:
    """Texts to numbers; the missing marker and what is no number become NULL."""
    return casts.withColumns({c: number(F.regexp_replace(F.col(c), MISSING_TEXT, "")) for c in columns})


def deepest(levels: DataFrame, key: str = "cast", level: str = "level") -> DataFrame:
    """The row of the greatest level (a number) of each cast; pre-aggregated, no window."""
    rest = [c for c in levels.columns if c != key]
    return levels.groupBy(key).agg(F.max_by(F.struct(*rest), level).alias("r")).select(key, "r.*")


def dedupe(casts: DataFrame, place: tuple[str, ...] = ("lat", "lon"), depth: str = "depth", tie: str = "cast") -> DataFrame:
    """Of the casts at one place, the deepest; ties go to the least ``tie``."""
    rest = [c for c in casts.columns if c not in place]
    best = F.max_by(F.struct(*rest), F.struct(F.col(depth), -F.col(tie)))
    return casts.groupBy(*place).agg(best.alias("r")).select(*place, "r.*")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
