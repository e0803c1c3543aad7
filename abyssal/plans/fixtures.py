"""Rasters, cubes and casts derived from the given tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from abyssal.operators.grid import Grid

GRID = Grid(16, 16, (0.0, 10.0, 50.0, 100.0, 500.0, 1500.0, 5500.0))
NROWS, NCOLS = 120, 125

_D = lambda x: f"cast({x} as double)"

SQL = {
    "cube": "select cast(l_orderkey % 16 as int) as i, cast(l_partkey % 16 as int) as j, cast(l_linenumber - 1 as int) as k, max(l_extendedprice) as v from lineitem group by 1, 2, 3",
    "cube_gaps": "select i, j, k, case when (i * 7 + j * 3 + k) % 11 = 0 then null else v end as v from cube",
    "bathy": f"select o_orderkey as id, {_D('o_custkey % 1500')} / {_D(100)} as x, {_D('o_orderkey % 1500')} / {_D(100)} as y, o_totalprice / {_D(100)} as d from orders",
    "bathy_wide": f"select id, x * {_D(1.2)} - {_D(1.5)} as x, y * {_D(1.2)} - {_D(1.5)} as y, d * {_D(1.2)} - {_D(60)} as d from bathy",
    "bathy_raster": f"select cast(cast(floor(o_orderkey / {_D(125)}) as bigint) % 120 as int) as row, cast(o_orderkey % 125 as int) as col, max(case when o_orderkey % 13 = 0 then null else {_D(200)} - o_totalprice / {_D(100)} end) as z from orders group by 1, 2",
    "casts": f"select user_id as cast_id, event_id as level, value as depth, case when event_type = 'error' then '---0---' else regexp_extract(props, '([0-9]+)', 1) end as obs, {_D('user_id % 180 - 90')} + {_D(0.25)} as lat, {_D('user_id * 7 % 360')} + {_D(0.12345)} as lon from events",
    "deepest": "select cast_id, level, depth, obs, lat, lon from (select *, row_number() over (partition by cast_id order by level desc) as rn from casts) t where rn = 1",
    "points": f"select level as id, cast_id, cast(case when obs = '---0---' then null else obs end as double) as obs, {_D('level % 1500')} / {_D(100)} as x, {_D('cast_id * 37 % 1500')} / {_D(100)} as y, depth * {_D(10)} as d, cast(cast_id % 120 as int) as row, cast(level % 125 as int) as col from casts",
}
_NEEDS = {"cube": ["lineitem"], "cube_gaps": ["cube"], "bathy": ["orders"], "bathy_wide": ["bathy"], "bathy_raster": ["orders"], "casts": ["events"], "deepest": ["casts"], "points": ["casts"]}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    (source,) = _NEEDS[name]
    return spark.sql(SQL[name].replace(f"from {source}", f"from {{{source}}}"), **{source: load(spark, sf_dir, source)})


def with_tables(*names: str) -> str:
    """The WITH clause that defines the derived tables for DuckDB."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in SQL and n not in order:
            add(_NEEDS[n][0])
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in order)
