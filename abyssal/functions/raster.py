"""Raster algebra as Column expressions. NODATA is NULL inside the engine; sentinels exist at the edges only."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinels of the file formats.
NULL_DEPTH = 349000000.0
NULL_TILE = 3000000.0
NODATA = -9999.0
NULL_MAP = -99999.0
NULL_CAST = -999999.0
LEAST_FLOAT = -3.4e38
MISSING_TEXT = "---0---"

# The upper and lower edges of the depth bins, negative down.
DEPTH_EDGES = [-15000, -10000, -8000, -6000, -5000, -4000, -3000, -2000, -1500, -1250, -1000, -750, -500, -300, -200, -100, -50, 0]


def set_null_land(z: Column) -> Column:
    """Heights at or above 0 become NULL."""
    return F.when(z < 0, z)


def null_if(z: Column, *sentinels: float) -> Column:
    return F.when(~z.isin(list(sentinels)), z)


def map_nodata(z: Column) -> Column:
    """NULL for the sentinels that map rasters carry, and for values below every float."""
    return F.when((z != NODATA) & (z != NULL_MAP) & (z > LEAST_FLOAT), z)


def fill_null(z: Column, value: float) -> Column:
    return F.coalesce(z, F.lit(float(value)))


def positive_down(z: Column, least: Column) -> Column:
    """Negate where the least value of the data set (or tile) is below 0."""
    return F.when(least < 0, -z).otherwise(z)


def cell_centre(index: Column, origin: float, size: float) -> Column:
    return F.lit(float(origin)) + F.lit(size / 2.0) + F.lit(float(size)) * index


def flip(index: Column, count: int | Column) -> Column:
    return (F.lit(count) if isinstance(count, int) else count) - 1 - index


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def round4(c: Column) -> Column:
    """Half to even, as NumPy rounds."""
    return F.bround(c, 4)


def number(text: Column) -> Column:
    """A number from a text, NULL where it is none."""
    return F.trim(text).try_cast("double")


def depth_bin(depth: Column, edges: list[int] | None = None) -> Column:
    """Upper edge of the right-closed bin that holds the depth; NULL outside."""
    edges = edges or DEPTH_EDGES
    out = F.lit(None).cast("int")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when((depth > low) & (depth <= high), high).otherwise(out)
    return out


# The WGS84 ellipsoid.
_A, _F = 6378137.0, 1 / 298.257223563
_E = math.sqrt(_F * (2 - _F))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres, Mercator on the ellipsoid."""
    phi = F.radians(lat)
    es = F.lit(_E) * F.sin(phi)
    return F.lit(_A) * F.radians(lon), F.lit(_A) * F.log(F.tan(F.lit(math.pi / 4) + phi / 2) * F.pow((1 - es) / (1 + es), F.lit(_E / 2)))


def inverse_mercator(x: Column, y: Column, steps: int = 6) -> tuple[Column, Column]:
    """Metres to degrees, by a fixed number of iterations."""
    t = F.exp(-y / _A)
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(steps):
        es = F.lit(_E) * F.sin(phi)
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - es) / (1 + es), F.lit(_E / 2)))
    return F.degrees(x / _A), F.degrees(phi)


_K0 = math.cos(math.radians(30)) / math.sqrt(1 - (_E * math.sin(math.radians(30))) ** 2)


def _authalic(phi: Column) -> Column:
    """The equal-area function of a latitude in radians, over 1 - e^2."""
    sin = F.sin(phi)
    es = F.lit(_E) * sin
    return sin / (1 - es * es) - F.lit(1 / (2 * _E)) * F.log((1 - es) / (1 + es))


_POLE = (1 - _E**2) * (1 / (1 - _E**2) - math.log((1 - _E) / (1 + _E)) / (2 * _E))


def behrmann(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres, cylindrical equal-area on the ellipsoid with a standard parallel of 30 degrees."""
    return F.lit(_A * _K0) * F.radians(lon), F.lit(_A) * (F.lit(1 - _E**2) * _authalic(F.radians(lat))) / F.lit(2 * _K0)


def inverse_behrmann(x: Column, y: Column, steps: int = 2) -> tuple[Column, Column]:
    """Metres to degrees: the series of the authalic latitude, then Newton steps. NULL beyond the poles."""
    q = F.lit(2 * _K0 / _A) * y
    beta = F.asin(F.when(F.abs(q) <= _POLE * (1 + 1e-12), F.greatest(F.least(q / F.lit(_POLE), F.lit(1.0)), F.lit(-1.0))))
    e2, e4, e6 = _E**2, _E**4, _E**6
    # fixed values: the series' published coefficients
    phi = beta + F.lit(e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + F.lit(23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + F.lit(761 * e6 / 45360) * F.sin(6 * beta)
    for _ in range(steps):
        es = F.lit(_E) * F.sin(phi)
        move = (1 - es * es) * (1 - es * es) / (2 * F.cos(phi)) * (q / F.lit(1 - e2) - _authalic(phi))
        phi = F.when(F.cos(phi) > 1e-6, phi + move).otherwise(phi)
    return F.degrees(x / F.lit(_A * _K0)), F.degrees(phi)


class Projection(NamedTuple):
    """A pair of functions: degrees to the plane, and back."""

    forward: Callable[[Column, Column], tuple[Column, Column]]
    inverse: Callable[[Column, Column], tuple[Column, Column]]


PROJECTIONS = {
    "degrees": Projection(lambda lon, lat: (lon, lat), lambda x, y: (x, y)),
    "mercator": Projection(mercator, inverse_mercator),
    "behrmann": Projection(behrmann, inverse_behrmann),
}
