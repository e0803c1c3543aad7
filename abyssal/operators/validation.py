"""Validation of estimates (tri) against observations (obs)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abyssal.functions.raster import DEPTH_EDGES, depth_bin
from abyssal.session import ship_code


# Variable -> column of the observations and unit.
OBSERVED = {"temp": ("Temperatur", "degrees C"), "sal": ("Salinity", "unitless"), "diso2": ("Oxygen", "ml per l")}


def observed_variable(name: str) -> tuple[str, str]:
    """The column of the observations and the unit of an interpolated variable."""
    if name not in OBSERVED:
        raise ValueError(f"no observations for '{name}'; known: {', '.join(OBSERVED)}")
    return OBSERVED[name]


def with_bathymetry(points: DataFrame) -> DataFrame:
    """Points at which the bathymetry has a value; the others are deleted before anything is counted."""
    return points.where(F.col("bathy_dep").isNotNull())


def observed(points: DataFrame) -> DataFrame:
    """Points that have a bathymetry and an observation; all statistics start from these."""
    return with_bathymetry(points).where(F.col("obs").isNotNull())


def depth_filter(points: DataFrame, cut_off: float) -> DataFrame:
    """Points whose cast depth over bathymetry lies within 1 - cut_off and 1 + cut_off; a bathymetry of 0 fails."""
    ratio = F.try_divide("depth", "bathy_dep")
    return points.withColumn("ratio", ratio).where(F.col("ratio").between(1 - cut_off, 1 + cut_off))


def retained(points: DataFrame, cut_off: float) -> DataFrame:
    """(n_all, n_kept, n_dropped) of the points with a bathymetry and an observation."""
    hit = F.try_divide("depth", "bathy_dep").between(1 - cut_off, 1 + cut_off)
    return observed(points).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(hit).alias("n_kept"), (F.count(F.lit(1)) - F.count_if(hit)).alias("n_dropped"))


def _pairs(points: DataFrame) -> DataFrame:
    return observed(points).where(F.col("tri").isNotNull())


def _error() -> Column:
    """The error of an estimate: observed minus estimated."""
    return F.col("obs") - F.col("tri")


def _correlation(x: Column, y: Column) -> Column:
    """Pearson's; NULL where either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def statistics(points: DataFrame) -> DataFrame:
    """(n, rmse, mean_diff, pearson) over pairs without NULL."""
    return _pairs(points).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(_error() * _error())).alias("rmse"), F.avg(_error()).alias("mean_diff"), _correlation(F.col("tri"), F.col("obs")).alias("pearson"))


def summary(points: DataFrame, cut_off: float) -> DataFrame:
    """(variant, n, rmse, mean_diff, pearson, p, depth_rmse): all points with a bathymetry and an observation, and those that the depth filter leaves.

    One pass; p is the two-sided value of the correlation; depth_rmse sets cast depths against the bathymetry.
    """
    rows = observed(points).withColumn("hit", F.coalesce(F.try_divide("depth", "bathy_dep").between(1 - cut_off, 1 + cut_off), F.lit(False)))
    rows = rows.select("*", F.explode(F.when(F.col("hit"), F.array(F.lit("original"), F.lit("filtered"))).otherwise(F.array(F.lit("original")))).alias("variant"))
    good, deep = F.col("tri").isNotNull(), F.col("bathy_dep") - F.col("depth")
    of = lambda c: F.when(good, c)
    out = rows.groupBy("variant").agg(
        F.count_if(good).alias("n"), F.sqrt(F.avg(of(_error() * _error()))).alias("rmse"), F.avg(of(_error())).alias("mean_diff"),
        _correlation(of(F.col("tri")), F.when(good, F.col("obs"))).alias("pearson"), F.sqrt(F.avg(deep * deep)).alias("depth_rmse"),
    )

    ship_code(points.sparkSession)

    def with_p(frames):
        for f in frames:
            yield f.assign(p=[pearson_p(r, n) if r == r and r is not None else None for r, n in zip(f["pearson"], f["n"])])

    return out.mapInPandas(with_p, "variant string, n long, rmse double, mean_diff double, pearson double, depth_rmse double, p double")  # a row per variant


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
    out = d
    for m in range(1, 300):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d or tiny)
            c = 1 + t / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs, from Student's t."""
    if n < 3 or abs(r) >= 1:
        return float("nan") if n < 3 else 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return _beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def binned(points: DataFrame) -> DataFrame:
    return _pairs(points).withColumns({"bin": depth_bin(F.col("depth")), "diff": _error()})


def depth_bins(points: DataFrame) -> DataFrame:
    """(bin, n, mean_diff) of all bins, also of those without points."""
    labels = points.sparkSession.createDataFrame([(e,) for e in DEPTH_EDGES[1:]], "bin int")
    stats = binned(points).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"))
    return labels.join(stats, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_diff")


def quantiles(rows: DataFrame, group: str, value: str, shares: list[float], buckets: int = 1024) -> DataFrame:
    """(group, n, q): exact interpolated quantiles as an array, by a histogram of each group and then only the buckets that hold the ranks.

    For few groups of any size: no task holds a group. A bucket's rows are sorted by themselves.
    """
    v, g = F.col(value), F.col(group)
    span = rows.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = rows.where(v.isNotNull()).select(g, v).join(F.broadcast(span), group)  # a row per group; groups are few
    at = at.withColumn("b", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int"))
    hist = at.groupBy(group, "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    hist = hist.withColumn("from", F.sum("c").over(W.partitionBy(group).orderBy("b")) - F.col("c"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("n") - 1)).alias("place")) for i, q in enumerate(shares)])
    ranks = hist.select(group, "b", "c", "n", "from", F.explode(places).alias("p"))
    ranks = ranks.select(group, "b", "c", "n", "from", "p.i", "p.place", F.explode(F.array_distinct(F.array(F.floor("p.place"), F.ceil("p.place")))).alias("rank"))
    ranks = ranks.where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("from") + F.col("c")))
    wanted = ranks.select(group, "b").distinct()
    inside = at.join(F.broadcast(wanted), [group, "b"], "left_semi")  # two buckets a group and share at most
    inside = inside.withColumn("k", F.row_number().over(W.partitionBy(group, "b").orderBy(value)) - 1)
    met = ranks.withColumn("k", F.col("rank") - F.col("from")).join(inside.select(group, "b", "k", v.alias("x")), [group, "b", "k"])
    each = met.groupBy(group, "n", "i", "place").agg(F.min("x").alias("a"), F.max("x").alias("z"))
    each = each.select(group, "n", "i", (F.col("a") + (F.col("z") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("q"))
    return each.groupBy(group, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))


def boxplot(points: DataFrame) -> DataFrame:
    """(bin, n, q1, median, q3, low, high, n_fliers): quartiles, and whiskers at the extremes within 1.5 IQR."""
    rows = binned(points).where("bin is not null").select("bin", "diff").persist()  # read four times; two numbers a point
    q = quantiles(rows, "bin", "diff", [0.25, 0.5, 0.75])
    q = q.select("bin", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("diff").between(F.col("q1") - reach, F.col("q3") + reach)
    at = rows.join(F.broadcast(q), "bin")  # a row per bin: 17 at most
    return at.groupBy("bin", "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("diff"))).alias("low"), F.max(F.when(inside, F.col("diff"))).alias("high"), F.count_if(~inside).alias("n_fliers"))


def spatial_error(points: DataFrame, cell: str = "cell") -> DataFrame:
    """(cell, n, mean_diff) of the net's cells that have points."""
    return _pairs(points).groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.avg(_error()).alias("mean_diff"))


def error_grid(net: DataFrame, errors: DataFrame, cell: str = "cell") -> DataFrame:
    """All cells of the net, with what ``spatial_error`` has of them."""
    return net.join(errors, cell, "left").select(cell, F.coalesce("n", F.lit(0)).alias("n"), "mean_diff")


def scatter_limits(points: DataFrame) -> DataFrame:
    return _pairs(points).agg(F.least(F.min("tri"), F.min("obs")).alias("low"), F.greatest(F.max("tri"), F.max("obs")).alias("high"))


def report(summarised: DataFrame, title: str) -> str:
    """A page of text from the two rows of ``summary``."""
    rows = sorted(summarised.collect(), key=lambda r: r.variant != "original")  # two rows
    names = [c for c in summarised.columns if c != "variant"]
    head = "".join(f"<th>{r.variant}</th>" for r in rows)
    body = "".join(f"<tr><td>{c}</td>" + "".join(f"<td>{r[c]}</td>" for r in rows) + "</tr>" for c in names)
    return f"<html><head><title>{title}</title></head><body><h1>{title}</h1><table><tr><th></th>{head}</tr>{body}</table></body></html>"
