"""A query per operator over the derived tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abyssal.functions import raster as R
from abyssal.operators import casts as C
from abyssal.operators import grid as G
from abyssal.operators import interpolation as I
from abyssal.operators import plots as L
from abyssal.operators import polygons as Y
from abyssal.operators import preflight as P
from abyssal.operators import tiling as T
from abyssal.operators import validation as V
from abyssal.sources import aaigrid as S
from abyssal.sources import ctd, geotiff
from abyssal.plans.fixtures import GRID, NCOLS, NROWS, load, with_tables
from abyssal.session import scratch
from abyssal.streaming import tiles as Z

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, tables: str = ""):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (with_tables(*tables.split()) + "\n" if tables else "") + sql
        return f

    return add


# ---------------------------------------------------------------- interpolation

_ZS = "[" + ", ".join(f"cast({z} as double)" for z in GRID.zs) + "]"
_ONE = "cast(1 as double)"


def _tri(points: str, cube: str, columns: str) -> str:
    """Trilinear interpolation as eight joins."""
    at = f"select *, least(greatest(cast(floor(x) as int), 0), 14) as i0, least(greatest(cast(floor(y) as int), 0), 14) as j0, least(greatest(cast(len(list_filter({_ZS}, lambda z: z <= d)) as int) - 1, 0), 5) as k0 from {points}"
    corners = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    joins = " ".join(f"left join {cube} c{a}{b}{c} on c{a}{b}{c}.i = i0 + {a} and c{a}{b}{c}.j = j0 + {b} and c{a}{b}{c}.k = k0 + {c}" for a, b, c in corners)
    plane = lambda c: f"((c00{c}.v * ({_ONE} - tx) + c10{c}.v * tx) * ({_ONE} - ty) + (c01{c}.v * ({_ONE} - tx) + c11{c}.v * tx) * ty)"
    t = f"select *, x - cast(i0 as double) as tx, y - cast(j0 as double) as ty, (d - {_ZS}[k0 + 1]) / ({_ZS}[k0 + 2] - {_ZS}[k0 + 1]) as tz from ({at})"
    return f"select {columns}, case when x between 0 and 15 and y between 0 and 15 and d between 0 and 5500 then {plane(0)} * ({_ONE} - tz) + {plane(1)} * tz end as tri from ({t}) p {joins}"


@query(_tri("bathy", "cube", "id, x, y, d"), "cube bathy")
def trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.trilinear(load(spark, sf_dir, "bathy"), load(spark, sf_dir, "cube"), GRID)


@query(_tri("bathy", "cube_gaps", "id, x, y, d"), "cube_gaps bathy")
def trilinear_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.trilinear(load(spark, sf_dir, "bathy"), load(spark, sf_dir, "cube_gaps"), GRID)


@query(_tri("bathy_wide", "cube", "id, x, y, d"), "cube bathy_wide")
def trilinear_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.trilinear(load(spark, sf_dir, "bathy_wide"), load(spark, sf_dir, "cube"), GRID)


_UNEVEN = G.rectilinear(tuple(i * (0.7 + 0.02 * i) for i in range(16)), tuple(15 * (j / 15) ** 1.5 for j in range(16)), GRID.zs)


def _uneven(points: str, cube: str) -> str:
    """Trilinear interpolation over uneven axes, as eight joins."""
    axis = {"x": _UNEVEN.xs, "y": _UNEVEN.ys, "d": _UNEVEN.zs}
    nodes = {c: "[" + ", ".join(f"cast({v!r} as double)" for v in a) + "]" for c, a in axis.items()}
    low = ", ".join(f"greatest(least(cast(len(list_filter({nodes[c]}, lambda v: v <= {c})) as int) - 1, {len(a) - 2}), 0) as {c}0" for c, a in axis.items())
    share = ", ".join(f"({c} - {nodes[c]}[{c}0 + 1]) / ({nodes[c]}[{c}0 + 2] - {nodes[c]}[{c}0 + 1]) as t{c}" for c in axis)
    corners = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    joins = " ".join(f"left join {cube} c{a}{b}{c} on c{a}{b}{c}.i = x0 + {a} and c{a}{b}{c}.j = y0 + {b} and c{a}{b}{c}.k = d0 + {c}" for a, b, c in corners)
    plane = lambda c: f"((c00{c}.v * ({_ONE} - tx) + c10{c}.v * tx) * ({_ONE} - ty) + (c01{c}.v * ({_ONE} - tx) + c11{c}.v * tx) * ty)"
    inside = " and ".join(f"{c} between {a[0]!r} and {a[-1]!r}" for c, a in axis.items())
    return f"select id, x, y, d, case when {inside} then round({plane(0)} * ({_ONE} - td) + {plane(1)} * td, 6) end as tri from (select *, {share} from (select *, {low} from {points})) p {joins}"


@query(_uneven("bathy", "cube_gaps"), "cube_gaps bathy")
def trilinear_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.trilinear(load(spark, sf_dir, "bathy"), load(spark, sf_dir, "cube_gaps"), _UNEVEN).withColumn("tri", F.round("tri", 6))


_CLAMPED = "(select id, x as x1, y as y1, d as d1, least(greatest(x, 0), 15) as x, least(greatest(y, 0), 15) as y, case when d >= 5500 then cast(5499 as double) when d < 0 then cast(0 as double) else d end as d from bathy_wide)"


@query(_tri(_CLAMPED, "cube", "id, x1 as x, y1 as y, d1 as d"), "cube bathy_wide")
def trilinear_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.trilinear(load(spark, sf_dir, "bathy_wide"), load(spark, sf_dir, "cube"), GRID, "clamp")


@query("""select id, x, y, d, case when p = '' then 'OK' else p end || case when d >= 5500 then 'Deep' when d < 0 then 'Land' else '' end as flag
from (select *, case when y < 0 then 'Bot' when y > 15 then 'Top' else '' end || case when x < 0 then 'Left' when x > 15 then 'Right' else '' end as p from bathy_wide)""", "bathy_wide")
def point_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.point_flags(load(spark, sf_dir, "bathy_wide"), GRID)


@query(""", r as (select k, i, max_by(v, j) filter (v is not null) as rg, min_by(v, j) filter (v is not null) as lg from cube_gaps group by k, i),
w as (select *, max(case when rg is not null then i end) over (partition by k order by i rows between unbounded preceding and 1 preceding) as pi,
  min(case when rg is not null then i end) over (partition by k order by i rows between 1 following and unbounded following) as ni from r)
select c.k, c.i, c.j, coalesce(c.v, w.rg, case when pi is null then n.lg when ni is null then p.rg else (n.lg - p.rg) / (ni - pi) * (w.i - pi) + p.rg end) as v
from cube_gaps c join w on c.k = w.k and c.i = w.i left join r p on p.k = w.k and p.i = pi left join r n on n.k = w.k and n.i = ni""", "cube_gaps")
def row_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.row_pad(load(spark, sf_dir, "cube_gaps"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The casts' observations, as many as the scale factor gives."""
    return load(spark, sf_dir, "points").where("obs is not null").select(F.col("id").alias("sid"), "x", "y", F.col("obs").alias("v"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "bathy").select("id", "x", "y")


@query(""", s as (select id as sid, x as sx, y as sy, obs as v from points where obs is not null),
d as (select b.id, any_value(b.x) as x, any_value(b.y) as y, min({'d2': (b.x - sx) * (b.x - sx) + (b.y - sy) * (b.y - sy), 'sid': sid, 'v': v}, 10) as near from bathy b, s group by b.id),
n as (select id, x, y, unnest(near).d2 as d2, unnest(near).sid as sid, unnest(near).v as v from d)
select id, x, y, round(case when min(d2) = 0 then min_by(v, {'d2': d2, 'sid': sid}) else sum(case when d2 > 0 then v / d2 end) / sum(case when d2 > 0 then 1 / d2 end) end, 6) as v from n group by id, x, y""", "points bathy")
def idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.idw(_targets(spark, sf_dir), _samples(spark, sf_dir), 10).withColumn("v", F.round("v", 6))


@query()
def kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.kriging(_targets(spark, sf_dir), _samples(spark, sf_dir), 10)


@query()
def spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.spline(_targets(spark, sf_dir), _samples(spark, sf_dir), 10)


@query()
def natural_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.natural_neighbour(_targets(spark, sf_dir), _samples(spark, sf_dir), 10)


@query()
def natural_then_idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.natural_then_idw(_targets(spark, sf_dir), _samples(spark, sf_dir), 10).select("id", "v")


@query(f"select id, d, list_extract(list_sort(list_transform({_ZS}, lambda z: {{'a': abs(z - d), 'z': z}})), 1).z as z from bathy_wide", "bathy_wide")
def nearest_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.nearest_depth(load(spark, sf_dir, "bathy_wide"), GRID).select("id", "d", "z")


_EDGES = ", t as (select *, case when id % 17 = 0 then null else d end as depth, cast(floor(x / cast(3 as double)) * 100 + floor(y / cast(3 as double)) as int) as tile_id from bathy_wide), e as (select tile_id, min(x) < 0 or max(x) > 15 or min(y) < 0 or max(y) > 15 as edge from t group by tile_id)\n"


def _tiled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "bathy_wide").withColumn("tile_id", (F.floor(F.col("x") / 3) * 100 + F.floor(F.col("y") / 3)).cast("int"))
    return points.withColumn("d", F.when(F.col("id") % 17 != 0, F.col("d")))


@query(_EDGES + "select tile_id, edge from e", "bathy_wide")
def edge_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.edge_tiles(_tiled_points(spark, sf_dir), GRID.extent)


@query(_EDGES + """select id, x, y, tile_id, case when not edge then case when depth is null then 'Flag 3' when depth >= 5500 or depth < 0 then 'Flag 4' else 'Flag 2' end
when depth is null then 'Flagged 1' when depth >= 5500 then case when y < 0 then 'Bot' when y > 15 and side <> '' then 'Up' when y > 15 then 'Top' when side = '' then 'OK' else '' end || side || 'Deep'
else case when y < 0 and side <> '' then 'Bot' when y < 0 then 'Bottom' when y > 15 and side <> '' then 'Up' when y > 15 then 'Top' when side = '' then 'OK' else '' end || side end as flag
from (select *, case when x < 0 then 'Left' when x > 15 then 'Right' else '' end as side from t join e using (tile_id))""", "bathy_wide")
def tile_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _tiled_points(spark, sf_dir)
    return I.tile_flags(points, T.edge_tiles(points, GRID.extent), GRID).select("id", "x", "y", "tile_id", "flag")


_TILED = ", t1 as (select id, x, y, depth as d, tile_id, case when depth >= 5500 then cast(5499 as double) when depth < 0 then cast(0 as double) else depth end as moved from t)\n"


@query(_EDGES.rstrip() + _TILED + "select p.id, p.x, p.y, p.tile_id, case when edge then cast(100000 as double) else tri end as tri, case when edge then 'Flag 5' when d is null then 'Flag 3' when d >= 5500 or d < 0 then 'Flag 4' else 'Flag 2' end as flag from t1 p join e using (tile_id) join (" + _tri("(select id, x, y, moved as d from t1)", "cube", "id") + ") v on v.id = p.id", "cube bathy_wide")
def tile_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over half of the tiles, then one over all: finished ones are skipped, tiles at the grid's edge fail."""
    points, cube = _tiled_points(spark, sf_dir), load(spark, sf_dir, "cube")
    base = scratch(spark, "tiles")
    for half in (0, 1):
        part = points.where(f"pmod(tile_id, 2) = {half}") if not half else points
        part.repartition("tile_id").write.mode("append").parquet(f"{base}/in")
        Z.run_tiles(spark, f"{base}/in", "id long, x double, y double, d double, tile_id int", cube, GRID, f"{base}/out", f"{base}/state", "fail").awaitTermination()
    return Z.results(spark, f"{base}/out").select("id", "x", "y", "tile_id", "tri", "flag")


# ---------------------------------------------------------------- catalog, axes, algebra


@query("select dim, cast(row_number() over (partition by dim order by coord) - 1 as int) as idx, coord, lead(coord) over (partition by dim order by coord) as next_coord from (select distinct dim, coord from (select 'i' as dim, cast(i as double) as coord from cube union all select 'j', j from cube union all select 'k', k from cube))", "cube")
def axis_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.axis_values(load(spark, sf_dir, "cube"))


@query("select 'temp_' || cast(k * 10 as varchar) as name, 'temp_' as variable, cast(k * 10 as int) as depth_m from (select distinct k from cube)", "cube")
def layer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "cube").select(F.concat(F.lit("temp_"), (F.col("k") * 10).cast("string")).alias("name")).distinct()
    return G.layer_catalog(names, "temp_")


@query("select row, col, case when z < 0 then z end as z from bathy_raster", "bathy_raster")
def set_null_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "bathy_raster").withColumn("z", R.set_null_land(F.col("z")))


@query("select row, col, coalesce(z, cast(3000000 as double)) as z from bathy_raster", "bathy_raster")
def fill_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "bathy_raster").withColumn("z", R.fill_null(F.col("z"), R.NULL_TILE))


@query("select row, col, case when z <> cast(3000000 as double) then z end as z from (select row, col, coalesce(z, cast(3000000 as double)) as z from bathy_raster)", "bathy_raster")
def null_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = load(spark, sf_dir, "bathy_raster").withColumn("z", R.fill_null(F.col("z"), R.NULL_TILE))
    return filled.withColumn("z", R.null_if(F.col("z"), R.NULL_TILE))


@query("select cast(row - 30 as int) as row, cast(col - 25 as int) as col, z from bathy_raster where row between 30 and 69 and col between 25 and 74", "bathy_raster")
def raster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.window(load(spark, sf_dir, "bathy_raster"), 30, 25, 40, 50)


@query("select i, j, v from cube where k = 4", "cube")
def depth_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.depth_slice(load(spark, sf_dir, "cube"), GRID, 500.0)


@query("select cast_id, level, coalesce(cast(case when obs = '---0---' then null else obs end as double), cast(-999999 as double)) as obs from casts", "casts")
def fill_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coerce(load(spark, sf_dir, "casts").select("cast_id", "level", "obs"), ["obs"]).na.fill(R.NULL_CAST, ["obs"])


@query("select cast_id, level, round(6378137 * k0 * radians(lon), 4) as x, round(6378137 * ((1 - e * e) * (s / (1 - e * e * s * s) - 1 / (2 * e) * ln((1 - e * s) / (1 + e * s)))) / (2 * k0), 4) as y from (select *, sin(radians(lat)) as s, cos(radians(30)) / sqrt(1 - e * e * cast(0.25 as double)) as k0 from casts, (select sqrt((1 / 298.257223563::double) * (2 - 1 / 298.257223563::double)) as e))", "casts")
def behrmann_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = R.behrmann(F.col("lon"), F.col("lat"))
    return load(spark, sf_dir, "casts").select("cast_id", "level", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("select row, col, case when (select min(z) from bathy_raster) < 0 then -z else z end as z from bathy_raster", "bathy_raster")
def sign_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = load(spark, sf_dir, "bathy_raster")
    least = raster.agg(F.min("z").alias("_least"))
    return raster.crossJoin(F.broadcast(least)).select("row", "col", R.positive_down(F.col("z"), F.col("_least")).alias("z"))  # one row


@query("select row, col, cast(-1000 as double) + cast(12.5 as double) + cast(25 as double) * col as x, cast(500 as double) + cast(12.5 as double) + cast(25 as double) * (119 - row) as y from bathy_raster", "bathy_raster")
def cell_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "bathy_raster").select("row", "col", R.cell_centre(F.col("col"), -1000, 25).alias("x"), R.cell_centre(R.flip(F.col("row"), NROWS), 500, 25).alias("y"))


@query("select cast_id, level, case when lon > 180 then lon - 360 else lon end as lon from casts", "casts")
def lon_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "casts").select("cast_id", "level", R.wrap_longitude(F.col("lon")).alias("lon"))


@query("select cast_id, level, round_even(lon, 4) as lon, round_even(lat, 4) as lat from casts", "casts")
def round4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "casts").select("cast_id", "level", R.round4(F.col("lon")).alias("lon"), R.round4(F.col("lat")).alias("lat"))


_MERC = "select cast_id, level, round(6378137 * radians(lon), 4) as x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2) * pow((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))), e / 2)), 4) as y from casts, (select sqrt((1 / 298.257223563::double) * (2 - 1 / 298.257223563::double)) as e) where abs(lat) < 90"


@query(_MERC, "casts")
def mercator_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = R.mercator(F.col("lon"), F.col("lat"))
    return load(spark, sf_dir, "casts").where(F.abs("lat") < 90).select("cast_id", "level", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("select cast_id, level, round(lon, 6) as lon, round(lat, 6) as lat from casts where abs(lat) < 90", "casts")
def mercator_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = R.mercator(F.col("lon"), F.col("lat"))
    at = load(spark, sf_dir, "casts").where(F.abs("lat") < 90).select("cast_id", "level", x.alias("x"), y.alias("y"))
    lon, lat = R.inverse_mercator(F.col("x"), F.col("y"))
    return at.select("cast_id", "level", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


# ---------------------------------------------------------------- tiles and mosaics

_NX, _NY = 5, 4
_TILES = ", tiles as (select *, cast(floor(col / cast(25 as double)) * 4 + floor((119 - row) / cast(30 as double)) as int) as tile_id from bathy_raster)\n"
_CLASSES = _TILES.rstrip() + ", classified as (select tile_id, count(*) as n, count(z) as n_good, min(z) as zmin, max(z) as zmax, case when count(z) = 0 then 'null' when min(z) = max(z) then 'fail' else 'pass' end as status from tiles group by tile_id)\n"


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tile_assign(load(spark, sf_dir, "bathy_raster"), NROWS, NCOLS, _NX, _NY)


@query(_TILES + "select row, col, z, tile_id from tiles", "bathy_raster")
def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir)


@query(_CLASSES + "select * from classified", "bathy_raster")
def tile_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tile_classify(_tiles(spark, sf_dir))


@query(_TILES + "select tile_id, 'sp' || cast(tile_id as varchar) as name, min(row) as rmin, max(row) as rmax, min(col) as cmin, max(col) as cmax from tiles group by tile_id", "bathy_raster")
def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tile_index(_tiles(spark, sf_dir))


@query(_CLASSES + "select * from tiles where tile_id in (select tile_id from classified where status = 'pass')", "bathy_raster")
def valid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _tiles(spark, sf_dir)
    return T.valid_tiles(tiles, T.tile_classify(tiles))


@query(_CLASSES + "select * from classified where tile_id not in (select tile_id from classified where tile_id % 3 = 0)", "bathy_raster")
def pending_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = T.tile_classify(_tiles(spark, sf_dir))
    return T.pending(classified, classified.where("tile_id % 3 = 0").select("tile_id"))


@query("select row, cast(124 - col as int) as col, z from bathy_raster", "bathy_raster")
def mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mirror(load(spark, sf_dir, "bathy_raster"), NCOLS)


_TWO = ", u as (select row, col, z, 0 as p from bathy_raster union all select row, cast(124 - col as int), z * cast(2 as double), 1 from bathy_raster)\n"


def _two(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    one = load(spark, sf_dir, "bathy_raster")
    return [one, T.mirror(one, NCOLS).withColumn("z", F.col("z") * 2)]


@query(_TWO + "select row, col, round(avg(z), 6) as z from u group by row, col", "bathy_raster")
def mosaic_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mosaic(_two(spark, sf_dir), "mean").withColumn("z", F.round("z", 6))


@query(_TWO + "select row, col, min_by(z, p) filter (z is not null) as z from u group by row, col", "bathy_raster")
def mosaic_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mosaic(_two(spark, sf_dir), "first")


@query(_TWO + "select row, col, max_by(z, p) filter (z is not null) as z from u group by row, col", "bathy_raster")
def mosaic_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mosaic(_two(spark, sf_dir), "last")


@query(", l as (select i as row, j as col, v as z from cube_gaps where k = 0), u as (select row, col, z, 0 as p from l union all select row - 3, col - 3, z, 1 from l union all select row + 3, col - 3, z, 2 from l union all select row + 3, col + 3, z, 3 from l union all select row - 3, col + 3, z, 4 from l)\nselect cast(row as int) as row, cast(col as int) as col, min_by(z, p) filter (z is not null) as z from u group by row, col", "cube_gaps")
def shift_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shift_pad(load(spark, sf_dir, "cube_gaps").where("k = 0").select(F.col("i").alias("row"), F.col("j").alias("col"), F.col("v").alias("z")))


_LAYERS = ", layers as (select cast(10 + k * 100 as double) as depth, i, j, v from cube)\n"


@query(_LAYERS + "select depth, i, j, v from layers union all select cast(0 as double), i, j, v from layers where depth = 10 union all select cast(611 as double), i, j, v from layers where depth = 610 union all select cast(900 as double), i, j, v from layers where depth = 610", "cube")
def depth_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = load(spark, sf_dir, "cube").select((10 + F.col("k") * 100).cast("double").alias("depth"), "i", "j", "v")
    return P.depth_extend(layers, 0.0, 800.0)


@query("select *, case when env_min < bathy_min then 'lower' when env_min = bathy_min then 'equal' else 'greater' end as top, case when env_max < bathy_max then 'lower' when env_max = bathy_max then 'equal' else 'greater' end as bottom from (select cast(min(k) as double) as env_min, cast(max(k) as double) as env_max from cube), (select min(d) as bathy_min, max(d) as bathy_max from bathy)", "cube bathy")
def depth_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.depth_coverage(load(spark, sf_dir, "cube").select(F.col("k").cast("double").alias("z")), load(spark, sf_dir, "bathy"))


@query(""", m as (select 'env' as name, min(i) - 1 as xmin, min(j) - 1 as ymin, max(i) + 1 as xmax, max(j) + 1 as ymax from cube), b as (select min(x) as bxmin, min(y) as bymin, max(x) as bxmax, max(y) as bymax from bathy)
select name, 'projected' as "check", 'pass' as status, 'Projected' as detail from m union all select name, 'same projection', 'pass', 'Behrmann' from m union all select name, 'metres', 'pass', 'Meter' from m
union all select name, 'square cells', 'pass', '1' from m union all select name, 'valid extent', case when xmin < xmax and ymin < ymax then 'pass' else 'fail' end, cast(xmin as varchar) from m
union all select name, 'covers', case when xmin <= bxmin - 1 and ymin <= bymin - 1 and xmax >= bxmax + 1 and ymax >= bymax + 1 then 'pass' else 'fail' end, cast(xmin as varchar) from m, b""", "cube bathy")
def crs_extent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = load(spark, sf_dir, "cube").agg((F.min("i") - 1).alias("xmin"), (F.min("j") - 1).alias("ymin"), (F.max("i") + 1).alias("xmax"), (F.max("j") + 1).alias("ymax"))
    bathy = load(spark, sf_dir, "bathy").agg(F.min("x").alias("bxmin"), F.min("y").alias("bymin"), F.max("x").alias("bxmax"), F.max("y").alias("bymax"))
    meta = env.crossJoin(bathy)  # one row each
    fixed = {"name": "env", "cs_type": "Projected", "cs_name": "Behrmann", "bathy_cs": "Behrmann", "xy_units": "Meter", "cell_x": 1, "cell_y": 1}
    return P.checks(meta.withColumns({k: F.lit(v) for k, v in fixed.items()}))


@query("select cast(max(row) - min(row) + 1 as int) as nrows, cast(max(col) - min(col) + 1 as int) as ncols, count(*) as n_cells, count(*) - count(z) as n_null, min(z) as minimum, max(z) as maximum from bathy_raster", "bathy_raster")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.describe(load(spark, sf_dir, "bathy_raster"))


_COARSE = "select cast(floor(row / cast(5 as double)) as int) as row, cast(floor(col / cast(5 as double)) as int) as col, {} as z from bathy_raster where row % 5 = 2 and col % 5 = 2"


@query(_COARSE.format("z"), "bathy_raster")
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resample_nearest(load(spark, sf_dir, "bathy_raster"), 5, NROWS, NCOLS)


@query(_COARSE.format("case when coalesce(z, -9999) <> -9999 then z end"), "bathy_raster")
def overview_null_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = load(spark, sf_dir, "bathy_raster").withColumn("z", R.fill_null(F.col("z"), R.NODATA))
    return G.resample_nearest(filled, 5, NROWS, NCOLS).withColumn("z", R.map_nodata(F.col("z")))


@query("select cast(i as int) as i, cast(j as int) as j, max(case when k = 0 then v end) as d0, max(case when k = 1 then v end) as d10, max(case when k = 2 then v end) as d50, max(case when k = 3 then v end) as d100, max(case when k = 4 then v end) as d500, max(case when k = 5 then v end) as d1500, max(case when k = 6 then v end) as d5500 from cube group by i, j", "cube")
def wide_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "cube").groupBy("i", "j").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"d{int(z)}") for k, z in enumerate(GRID.zs)])


_LAYER_NAMES = "case k when 0 then 0 when 1 then 10 when 2 then 50 when 3 then 100 when 4 then 500 when 5 then 1500 else 5500 end"


@query("select i, j, k, v from cube", "cube")
def cube_of_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = load(spark, sf_dir, "cube")
    layers = cube.select(F.concat(F.lit("temp"), F.expr(_LAYER_NAMES).cast("string")).alias("name"), (F.lit(15) - F.col("j")).alias("row"), F.col("i").alias("col"), F.col("v").alias("z"))
    return G.cube_of_layers(layers, G.layer_catalog(layers.select("name").distinct(), "temp"), 16)


@query("select cast_id, level, case when col between 0 and 1899 and row between 0 and 999 then row end as row, case when col between 0 and 1899 and row between 0 and 999 then col end as col from (select cast_id, level, cast(floor((lon - cast(-190 as double)) / cast(0.2 as double)) as int) as col, cast(999 - floor((lat - cast(-100 as double)) / cast(0.2 as double)) as int) as row from casts)", "casts")
def grid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = G.cell_index(F.col("lon"), F.col("lat"), G.Spec(-190.0, -100.0, 190.0, 100.0, 0.2))
    return load(spark, sf_dir, "casts").select("cast_id", "level", row.alias("row"), col.alias("col"))


_DEGREES, _METRES = G.Spec(-125.0, -60.0, 125.0, 60.0, 1.0), G.Spec(-13_000_000.0, -8_000_000.0, 13_000_000.0, 8_000_000.0, 100_000.0)
_E = "(select sqrt((1 / 298.257223563::double) * (2 - 1 / 298.257223563::double)) as e)"
_STEPS = "".join(f", p{n + 1} as (select row, y, e, t, pi() / 2 - 2 * atan(t * pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2)) as phi from p{n})" for n in range(6))


@query(f""", c as (select cast(floor(o_orderkey % 30000 / cast(250 as double)) as int) as row, cast(o_orderkey % 250 as int) as col, max(o_totalprice) as z from orders group by 1, 2),
p0 as (select row, y, e, exp(-y / cast(6378137 as double)) as t, pi() / 2 - 2 * atan(exp(-y / cast(6378137 as double))) as phi from (select cast(r as int) as row, cast(8000000 as double) - (r + cast(0.5 as double)) * cast(100000 as double) as y from range(160) g(r)), {_E}){_STEPS},
rows as (select row, cast(119 - floor((degrees(phi) + cast(60 as double)) / cast(1 as double)) as int) as sr from p6),
cols as (select cast(k as int) as col, cast(floor((degrees((cast(-13000000 as double) + (k + cast(0.5 as double)) * cast(100000 as double)) / cast(6378137 as double)) + cast(125 as double)) / cast(1 as double)) as int) as sc from range(260) g(k))
select rows.row, cols.col, c.z from rows cross join cols left join c on c.row = sr and c.col = sc and sc between 0 and 249 and sr between 0 and 119""", "cube")
def reproject_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    raster = orders.groupBy(F.floor(F.col("o_orderkey") % 30000 / 250).cast("int").alias("row"), (F.col("o_orderkey") % 250).cast("int").alias("col")).agg(F.max("o_totalprice").alias("z"))
    return G.reproject_mercator(raster, _DEGREES, _METRES)


_PLANE = G.Spec(-12_000_000.0, -6_400_000.0, 12_000_000.0, 6_400_000.0, 100_000.0)
_FORWARD = "6378137 * k0 * radians({0}) as x, 6378137 * ((1 - e * e) * (s / (1 - e * e * s * s) - 1 / (2 * e) * ln((1 - e * s) / (1 + e * s)))) / (2 * k0) as y"
_CONSTANTS = "(select e, cos(radians(30)) / sqrt(1 - e * e * cast(0.25 as double)) as k0 from (select sqrt((1 / 298.257223563::double) * (2 - 1 / 298.257223563::double)) as e))"


def _plane_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' prices as cells of a raster in Behrmann metres."""
    return load(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") % 30720 / 240).cast("int").alias("row"), (F.col("o_orderkey") % 240).cast("int").alias("col")).agg(F.max("o_totalprice").alias("z"))


# Behrmann metres to degrees, by the forward formula at each target centre; then on to Mercator as above
@query(f""", c as (select cast(floor(o_orderkey % 30720 / cast(240 as double)) as int) as row, cast(o_orderkey % 240 as int) as col, max(o_totalprice) as z from orders group by 1, 2),
g as (select cast(r as int) as row, cast(k as int) as col, {_FORWARD.format('lon')} from (select r, k, sin(radians(cast(60 as double) - (r + cast(0.5 as double)))) as s, cast(-125 as double) + (k + cast(0.5 as double)) as lon from range(120) a(r), range(250) b(k)), {_CONSTANTS}),
deg as (select g.row, g.col, c.z from g left join c on c.row = 127 - floor((y + cast(6400000 as double)) / cast(100000 as double)) and c.col = floor((x + cast(12000000 as double)) / cast(100000 as double))),
p0 as (select row, y, e, exp(-y / cast(6378137 as double)) as t, pi() / 2 - 2 * atan(exp(-y / cast(6378137 as double))) as phi from (select cast(r as int) as row, cast(8000000 as double) - (r + cast(0.5 as double)) * cast(100000 as double) as y from range(160) g(r)), {_E}){_STEPS},
rows as (select row, cast(119 - floor((degrees(phi) + cast(60 as double)) / cast(1 as double)) as int) as sr from p6),
cols as (select cast(k as int) as col, cast(floor((degrees((cast(-13000000 as double) + (k + cast(0.5 as double)) * cast(100000 as double)) / cast(6378137 as double)) + cast(125 as double)) / cast(1 as double)) as int) as sc from range(260) g(k))
select rows.row, cols.col, deg.z from rows cross join cols left join deg on deg.row = sr and deg.col = sc""", "cube")
def reproject_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behrmann metres to degrees to Mercator metres."""
    degrees = G.reproject(_plane_raster(spark, sf_dir), _PLANE, _DEGREES, "behrmann", "degrees")
    return G.reproject(degrees, _DEGREES, _METRES, "degrees", "mercator")


@query("select cast_id, level, round(lon, 6) as lon, round(lat, 6) as lat from casts", "casts")
def behrmann_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = R.behrmann(F.col("lon"), F.col("lat"))
    at = load(spark, sf_dir, "casts").select("cast_id", "level", x.alias("x"), y.alias("y"))
    lon, lat = R.inverse_behrmann(F.col("x"), F.col("y"))
    return at.select("cast_id", "level", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(_CLASSES + "select * from classified where tile_id = (select min(tile_id) from classified where status = 'pass')", "bathy_raster")
def template_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.template_tile(T.tile_classify(_tiles(spark, sf_dir)))


@query(_TILES.rstrip() + ", b as (select tile_id, row, string_agg(cast(cast(coalesce(round(z), cast(-9999 as double)) as int) as varchar) || '.0', ' ' order by col) as line from tiles group by tile_id, row) select tile_id, row, line from b", "bathy_raster")
def ascii_grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grid_lines(_tiles(spark, sf_dir).withColumn("z", F.round("z")))


@query("select cast(r as int) as row, cast(c as int) as col, cast(-1000 as double) + cast(12.5 as double) + cast(25 as double) * c as x, cast(500 as double) + cast(12.5 as double) + cast(25 as double) * (119 - r) as y, z from range(120) a(r) cross join range(125) b(c) left join bathy_raster on row = r and col = c", "bathy_raster")
def ascii_grid_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster written as one ASCII grid in parts, and read again in blocks."""
    path = scratch(spark, "grid")
    S.write_grid(load(spark, sf_dir, "bathy_raster"), path, NROWS, NCOLS, -1000.0, 500.0, 25.0)
    return S.read_grids(spark, path, parts=True).drop("path")


@query(_TILES.rstrip() + """, b as (select tile_id, min(row) as r0, max(row) as r1, min(col) as c0, max(col) as c1 from tiles group by tile_id)
select cast(b.tile_id as int) as tile_id, cast(-1000 as double) + (c + cast(0.5 as double)) * 25 as x, cast(500 as double) - (r + cast(0.5 as double)) * 25 as y, z from b join range(120) p(r) on r between r0 and r1 join range(125) q(c) on c between c0 and c1 left join tiles t on t.tile_id = b.tile_id and t.row = r and t.col = c""", "bathy_raster")
def geotiff_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster's tiles written as GeoTIFFs and read again."""
    path = scratch(spark, "tiff")
    geotiff.write_tiles(_tiles(spark, sf_dir), path, -1000.0, 500.0, 25.0)
    return geotiff.read_tiles(spark, path).select(F.regexp_extract("path", "tile_id=([0-9]+)", 1).cast("int").alias("tile_id"), "x", "y", "z")


@query("select n_name as bathymetry, r_name as variable from nation, region")
def job_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(F.col("n_name").alias("bathymetry")).crossJoin(F.broadcast(load(spark, sf_dir, "region").select(F.col("r_name").alias("variable"))))  # job lists


# ---------------------------------------------------------------- polygons

# a star with a hole for each supplier: twelve outer vertices, five inner ones
_VERTICES = """select s_suppkey as id, 0 as ring, cast(v as int) as v, cast(s_suppkey * 37 % 150 as double) / 10 + cos(v * pi() / 6 + 0.1234) * (case when v % 2 = 0 then 1.3 else 0.7 end + cast(s_suppkey % 7 as double) / 10) as x, cast(s_suppkey * 53 % 150 as double) / 10 + sin(v * pi() / 6 + 0.1234) * (case when v % 2 = 0 then 1.3 else 0.7 end + cast(s_suppkey % 7 as double) / 10) as y from supplier, range(12) r(v)
union all select s_suppkey, 1, cast(v as int), cast(s_suppkey * 37 % 150 as double) / 10 + cos(v * pi() / 2.5 + 0.4321) * 0.5, cast(s_suppkey * 53 % 150 as double) / 10 + sin(v * pi() / 2.5 + 0.4321) * 0.5 from supplier, range(5) r(v)"""
_EDGE = f", verts as ({_VERTICES}), edges as (select a.id, a.ring, a.x as x0, a.y as y0, b.x as x1, b.y as y1 from verts a join verts b on a.id = b.id and a.ring = b.ring and b.v = (a.v + 1) % case when a.ring = 0 then 12 else 5 end)\n"
_ODD = "count(*) filter ((y0 <= {1}) <> (y1 <= {1}) and x0 + ({1} - y0) / (y1 - y0) * (x1 - x0) > {0}) % 2 = 1"


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, wkt)"""
    vertices = spark.sql(_VERTICES.replace("from supplier", "from {s}").replace("range(12) r(v)", "(select id as v from range(12))").replace("range(5) r(v)", "(select id as v from range(5))"), s=load(spark, sf_dir, "supplier"))
    rings = vertices.groupBy("id", "ring").agg(F.array_sort(F.collect_list(F.struct("v", "x", "y"))).alias("p"))
    text = F.concat_ws(", ", F.transform("p", lambda e: F.concat_ws(" ", e["x"].cast("string"), e["y"].cast("string"))))
    rings = rings.select("id", "ring", F.concat(F.lit("("), text, F.lit(", "), F.element_at("p", 1)["x"].cast("string"), F.lit(" "), F.element_at("p", 1)["y"].cast("string"), F.lit(")")).alias("t"))
    return rings.groupBy("id").agg(F.concat(F.lit("POLYGON ("), F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("ring", "t"))), lambda r: r["t"])), F.lit(")")).alias("wkt"))


@query(_EDGE + f", c as (select cast(r as int) as row, cast(k as int) as col, (k + cast(0.5 as double)) * cast(0.125 as double) as cx, (119 - r + cast(0.5 as double)) * cast(0.125 as double) as cy from range(120) a(r), range(120) b(k)), h as (select id, row, col from c, edges group by id, row, col, cx, cy having {_ODD.format('cx', 'cy')}) select row, col, min(id) as id from h group by row, col", "points")
def polygon_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.to_raster(_stars(spark, sf_dir), G.Spec(0.0, 0.0, 15.0, 15.0, 0.125))


@query(_EDGE + f", h as (select p.id as no, e.id as polygon from points p, edges e group by p.id, e.id, p.x, p.y having {_ODD.format('p.x', 'p.y')}) select p.id, p.x, p.y, h.polygon from points p left join h on h.no = p.id", "points")
def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.within(load(spark, sf_dir, "points").select("id", "x", "y"), _stars(spark, sf_dir))


@query(_EDGE + "select id, round(max(area) filter (ring = 0) - max(area) filter (ring = 1), 6) as area, round(sum(length), 6) as length from (select id, ring, abs(sum(x0 * y1 - x1 * y0)) / 2 as area, sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) as length from edges group by id, ring) group by id", "points")
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.measures(_stars(spark, sf_dir)).select("id", F.round("area", 6).alias("area"), F.round("length", 6).alias("length"))


# ---------------------------------------------------------------- casts and validation


def _cast_files(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """(path, text): the casts as the files that instruments' archives hold, 50 casts a file.

    With ``coarse`` the casts are dealt to seven files, lie on a net of ten degrees, and each eleventh has no levels.
    """
    casts = load(spark, sf_dir, "casts")
    line = F.concat_ws(",", F.col("level").cast("string"), F.col("depth").cast("string"), F.lit("0"), F.lit("0"), "obs", F.lit("0"), F.lit("0"))
    file = F.floor(F.col("cast_id") / 50)
    if coarse:
        casts = casts.withColumns({c: F.floor(F.col(c) / 10) * 10.0 for c in ("lat", "lon")})
        line, file = F.when(F.col("cast_id") % 11 != 0, line), F.col("cast_id") % 7
    one = casts.groupBy("cast_id", "lat", "lon").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", line.alias("l")))), lambda x: x["l"]).alias("levels"))
    head = F.concat_ws("\n", F.lit("#--------"), F.concat(F.lit("CAST,,"), F.col("cast_id").cast("string"), F.lit(",")), F.concat(F.lit("Latitude,,"), F.col("lat").cast("string"), F.lit(",")), F.concat(F.lit("Longitude,,"), F.col("lon").cast("string"), F.lit(",")), F.lit("VARIABLES,Depth,F,O,Temperatur,F,O"), F.lit("Prof-Flag,,0"))
    text = F.concat_ws("\n", head, F.concat_ws("\n", "levels"), F.lit("END OF VARIABLES SECTION"))
    each = one.select(F.concat(F.lit("f"), file.cast("string")).alias("path"), "cast_id", text.alias("t"))
    return each.groupBy("path").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("cast_id", "t"))), lambda x: x["t"])).alias("text"))


def _cast_folder(spark: SparkSession, sf_dir: str, coarse: bool = False) -> str:
    path = scratch(spark, "casts")
    _cast_files(spark, sf_dir, coarse).write.partitionBy("path").text(path)
    return path


_LEVELS = "select cast(cast_id as varchar) as \"cast\", lat, lon, cast(level as int) as level, depth as \"Depth\", cast(case when obs = '---0---' then null else obs end as double) as \"Temperatur\" from casts"


@query(_LEVELS, "casts")
def cast_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coerce(C.variables(C.parse(_cast_files(spark, sf_dir)), ["Depth", "Temperatur"]), ["Depth", "Temperatur"])


@query(_LEVELS, "casts")
def cast_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, _ = ctd.scan(spark, _cast_folder(spark, sf_dir))
    return C.coerce(C.variables(levels, ["Depth", "Temperatur"]), ["Depth", "Temperatur"])


@query(""", n as (select cast_id, cast_id % 7 as file, row_number() over (partition by cast_id % 7 order by cast_id) as cast_no from (select distinct cast_id from casts)),
d as (select cast_id, level, depth, obs, floor(lat / 10) * 10 as lat, floor(lon / 10) * 10 as lon from casts where cast_id % 11 <> 0 and depth is not null qualify row_number() over (partition by cast_id order by level desc) = 1)
select cast_no, cast(cast_id as varchar) as "cast", lat, lon, cast(level as int) as level, -depth as "Depth", cast(case when obs = '---0---' then null else obs end as double) as "Temperatur" from d join n using (cast_id)
qualify row_number() over (partition by file, lat, lon order by depth desc, cast_no) = 1""", "casts")
def cast_files_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctd.cleaned(*ctd.scan(spark, _cast_folder(spark, sf_dir, True)), ["Depth", "Temperatur"])[0].drop("path")


@query("select count(distinct cast_id) as n_casts, count(distinct cast_id) filter (cast_id % 11 = 0) as n_failed from casts", "casts")
def failed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctd.cleaned(*ctd.scan(spark, _cast_folder(spark, sf_dir, True)), ["Depth", "Temperatur"])[1]


@query("select cast_id, level, depth, obs, lat, lon from deepest", "deepest")
def deepest_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.deepest(load(spark, sf_dir, "casts"), "cast_id")


@query("select lat, lon, cast_id, depth from (select *, row_number() over (partition by lat, lon order by depth desc, cast_id) as rn from (select cast_id, max(depth) as depth, floor(lat / 10) * 10 as lat, floor(lon / 10) * 10 as lon from casts group by cast_id, lat, lon)) where rn = 1", "casts")
def cast_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    casts = load(spark, sf_dir, "casts").groupBy("cast_id", "lat", "lon").agg(F.max("depth").alias("depth"))
    casts = casts.select("cast_id", "depth", (F.floor(F.col("lat") / 10) * 10).cast("double").alias("lat"), (F.floor(F.col("lon") / 10) * 10).cast("double").alias("lon"))
    return C.dedupe(casts, tie="cast_id")


@query("select cast_id, level, cast(case when obs = '---0---' then null else obs end as double) as obs from casts", "casts")
def cast_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coerce(load(spark, sf_dir, "casts").select("cast_id", "level", "obs"), ["obs"])


@query("select cast_id, level, obs, cast(null as double) as depth from casts where level % 2 = 0 union all select cast_id, level, null, depth from casts where level % 2 = 1", "casts")
def cast_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    casts = load(spark, sf_dir, "casts")
    return C.union([casts.where("level % 2 = 0").select("cast_id", "level", "obs"), casts.where("level % 2 = 1").select("cast_id", "level", "depth")])


@query("select p.id, p.row, p.col, b.z as bathy_dep from points p left join bathy_raster b on p.row = b.row and p.col = b.col", "points bathy_raster")
def raster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sample(load(spark, sf_dir, "points").select("id", "row", "col"), load(spark, sf_dir, "bathy_raster"), "z", "bathy_dep")


_VP = (
    ", tri as (" + _tri("points", "cube", "id, x, y, d, row, col, obs") + "),\nvp as (select t.id, t.x, t.y, -t.d as depth, t.obs, t.tri / cast(1000 as double) as tri, case when t.id % 50 = 0 then cast(0 as double) else b.z end as bathy_dep,"
    " case when x >= 0 and x < 15 and y >= 0 and y < 15 then cast(floor(y / cast(0.06 as double)) * 250 + floor(x / cast(0.06 as double)) as int) end as cell from tri t left join bathy_raster b on t.row = b.row and t.col = b.col)\n"
)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation points: estimate, observation, depth negative down, bathymetry and cell of the net."""
    tri = I.trilinear(load(spark, sf_dir, "points"), load(spark, sf_dir, "cube"), GRID)
    at = G.sample(tri, load(spark, sf_dir, "bathy_raster"), "z", "bathy_dep")
    return at.select("id", "x", "y", (-F.col("d")).alias("depth"), "obs", (F.col("tri") / 1000).alias("tri"), F.when(F.col("id") % 50 == 0, 0.0).otherwise(F.col("bathy_dep")).alias("bathy_dep"), G.fishnet_id(F.col("x"), F.col("y"), GRID.extent).alias("cell"))


_T = "points cube bathy_raster"
_BOTH = "where bathy_dep is not null and obs is not null and tri is not null"
_WITHIN = _BOTH + " and bathy_dep <> 0 and depth / nullif(bathy_dep, 0) between cast(0.5 as double) and cast(1.5 as double)"
_CUT_OFF = 0.5


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.depth_filter(_points(spark, sf_dir), _CUT_OFF)


@query(_VP + "select id, depth, bathy_dep, depth / bathy_dep as ratio from vp where bathy_dep <> 0 and depth / bathy_dep between cast(0.5 as double) and cast(1.5 as double)", _T)
def depth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.depth_filter(_points(spark, sf_dir), 0.5).select("id", "depth", "bathy_dep", "ratio")


@query(_VP + "select id, depth, bathy_dep, obs from vp where bathy_dep is not null", _T)
def with_bathymetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_bathymetry(_points(spark, sf_dir)).select("id", "depth", "bathy_dep", "obs")


@query(_VP + "select count(*) as n_all, count(*) filter (h) as n_kept, count(*) - count(*) filter (h) as n_dropped from (select coalesce(bathy_dep <> 0 and depth / nullif(bathy_dep, 0) between cast(0.5 as double) and cast(1.5 as double), false) as h from vp where bathy_dep is not null and obs is not null)", _T)
def retained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.retained(_points(spark, sf_dir), 0.5)


def _stat(sql: str) -> str:
    return _VP + f"select count(*) as n, round({sql}, 6) as value from vp {_BOTH}"


@query(_stat("sqrt(avg((obs - tri) * (obs - tri)))"), _T)
def rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.statistics(_points(spark, sf_dir)).select("n", F.round("rmse", 6).alias("value"))


@query(_stat("avg(obs - tri)"), _T)
def mean_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.statistics(_points(spark, sf_dir)).select("n", F.round("mean_diff", 6).alias("value"))


@query(_stat("corr(tri, obs)"), _T)
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.statistics(_points(spark, sf_dir)).select("n", F.round("pearson", 6).alias("value"))


_VARIANTS = "u as (select 'original' as variant, * from vp where bathy_dep is not null and obs is not null union all select 'filtered', * from vp where obs is not null and bathy_dep <> 0 and depth / nullif(bathy_dep, 0) between cast(0.5 as double) and cast(1.5 as double))\n"


# the density of a correlation of n pairs, by its angle, is a power of the cosine; both integrals by the midpoint rule
@query(_VP.rstrip() + ", " + _VARIANTS.rstrip() + """, r as (select variant, count(*) as n, corr(tri, obs) as r from u where tri is not null group by variant), g as (select unnest(range(0, 200000)) + cast(0.5 as double) as i)
select variant, n, round(any_value(r), 6) as pearson, round(any_value(pi() / 2 - asin(abs(r))) * sum(pow(cos(asin(abs(r)) + i * (pi() / 2 - asin(abs(r))) / 200000), n - 3)) / (pi() / 2 * sum(pow(cos(i * pi() / 2 / 200000), n - 3))), 6) as p from r, g group by variant, n""", _T)
def pearson_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(_points(spark, sf_dir), _CUT_OFF).select("variant", "n", F.round("pearson", 6).alias("pearson"), F.round("p", 6).alias("p"))


@query(_VP.rstrip() + ", " + _VARIANTS +
    "select variant, count(*) filter (tri is not null) as n, round(sqrt(avg((obs - tri) * (obs - tri))), 6) as rmse, round(avg(obs - tri), 6) as mean_diff, round(corr(tri, obs), 6) as pearson, round(sqrt(avg((bathy_dep - depth) * (bathy_dep - depth))), 6) as depth_rmse from u group by variant", _T)
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.summary(_points(spark, sf_dir), _CUT_OFF).drop("p")
    return out.withColumns({c: F.round(c, 6) for c in ("rmse", "mean_diff", "pearson", "depth_rmse")})


_BINS = "(values " + ", ".join(f"({a}, {b})" for a, b in zip(R.DEPTH_EDGES, R.DEPTH_EDGES[1:])) + ") as e(lo, bin)"


@query(_VP + f"select bin, count(id) as n, round(avg(obs - tri), 6) as mean_diff from {_BINS} left join (select * from vp {_WITHIN}) on depth > lo and depth <= bin group by bin", _T)
def depth_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.depth_bins(_filtered(spark, sf_dir)).withColumn("mean_diff", F.round("mean_diff", 6))


@query(_VP.rstrip() + f", b as (select bin, obs - tri as diff from {_BINS} join (select * from vp {_WITHIN}) on depth > lo and depth <= bin), q as (select bin, count(*) as n, quantile_cont(diff, 0.25) as q1, quantile_cont(diff, 0.5) as median, quantile_cont(diff, 0.75) as q3 from b group by bin)\n" + "select q.bin, n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(min(diff) filter (i), 6) as low, round(max(diff) filter (i), 6) as high, count(*) filter (not i) as n_fliers from q join (select b.bin, diff, diff between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as i from b join q on b.bin = q.bin) d on q.bin = d.bin group by q.bin, n, q1, median, q3", _T)
def boxplot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.boxplot(_filtered(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "low", "high")})


@query(_VP + "select id, x, y, cell from vp", _T)
def fishnet_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("id", "x", "y", "cell")


@query(_VP + f"select cell, count(*) as n, round(avg(obs - tri), 6) as mean_diff from vp {_WITHIN} group by cell", _T)
def spatial_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.spatial_error(_filtered(spark, sf_dir)).withColumn("mean_diff", F.round("mean_diff", 6))


@query(_VP + f"select cast(g.cell as int) as cell, count(id) as n, round(avg(obs - tri), 6) as mean_diff from range(62500) g(cell) left join (select * from vp {_WITHIN}) v on v.cell = g.cell group by g.cell", _T)
def error_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = G.fishnet(spark, GRID.extent).select(F.col("id").alias("cell"))
    return V.error_grid(net, V.spatial_error(_filtered(spark, sf_dir))).withColumn("mean_diff", F.round("mean_diff", 6))


@query(_VP + f"select least(min(tri), min(obs)) as low, greatest(max(tri), max(obs)) as high from vp {_BOTH}", _T)
def scatter_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scatter_limits(_points(spark, sf_dir))


_PLOTS = {"original_depth": ("depth", "bathy_dep", "original"), "filtered_depth": ("depth", "bathy_dep", "filtered"), "original_tri": ("tri", "obs", "original"), "filtered_tri": ("tri", "obs", "filtered")}


def _plot_sql(name: str, x: str, y: str, variant: str) -> str:
    pixel = lambda c: f"cast(case when hi > lo then least(floor(({c} - lo) / (hi - lo) * 200), 199) else 0 end as int)"
    return f"select '{name}' as plot, {pixel('x')} as px, {pixel('y')} as py, count(*) as n from (select x, y, least(min(x) over (), min(y) over ()) as lo, greatest(max(x) over (), max(y) over ()) as hi from (select {x} as x, {y} as y from u where variant = '{variant}' and {x} is not null and {y} is not null)) group by 1, 2, 3"


@query(_VP.rstrip() + ", " + _VARIANTS + " union all ".join(_plot_sql(n, *p) for n, p in _PLOTS.items()), _T)
def scatter_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four scatter plots of a validation, as counts of pixels."""
    points = V.observed(_points(spark, sf_dir))
    rows = {"original": points, "filtered": V.depth_filter(points, _CUT_OFF)}
    parts = [L.scatter_pixels(rows[v], x, y).select(F.lit(n).alias("plot"), "px", "py", "n") for n, (x, y, v) in _PLOTS.items()]
    return C.union(parts)


@query("select cast(floor(col / cast(1 as double)) as int) as px, cast(119 - row as int) as py, round(avg(z), 6) as z from bathy_raster where z is not null group by 1, 2", "bathy_raster")
def overview_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.raster_pixels(load(spark, sf_dir, "bathy_raster"), NROWS, NCOLS).withColumn("z", F.round("z", 6))
