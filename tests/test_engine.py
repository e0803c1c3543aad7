"""Literal cases, properties, and every registered query against its SQL."""

import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from abyssal.functions import raster as R
from abyssal.operators import casts, grid, interpolation, polygons, preflight, tiling, validation
from abyssal.operators.grid import Grid
from abyssal.plans import queries as plans
from abyssal.sources import aaigrid

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        name = f.split(".")[0]
        con.sql(f"create view {name} as select * from '{DATA}/{f}'")
    return con


def plain(rows):
    return sorted((tuple(None if x is None or x != x else x for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) == plain(want.select(*[f'"{c}"' for c in sorted(want.columns)]).fetchall())


def test_trilinear_against_the_definition(spark):
    zs, rng = (0.0, 10.0, 50.0, 500.0), random.Random(1)
    g = Grid(6, 5, zs, x0=-2.0, y0=1.0, dx=0.5, dy=2.0)
    v = {(i, j, k): rng.uniform(-5, 5) for i in range(6) for j in range(5) for k in range(4)}
    v[2, 2, 1] = None
    cube = spark.createDataFrame([(*p, x) for p, x in v.items()], "i int, j int, k int, v double")
    points = [(n, rng.uniform(-2.6, 1.0), rng.uniform(0, 10), rng.uniform(-20, 520)) for n in range(300)]
    points += [(1000 + n, -2.0 + 0.5 * i, 1.0 + 2.0 * j, zs[k]) for n, (i, j, k) in enumerate(v)]
    frame = spark.createDataFrame(points, "id int, x double, y double, d double")
    got = {r.id: r.tri for r in interpolation.trilinear(frame, cube, g).collect()}
    for n, x, y, d in points:
        want = None
        if -2.0 <= x <= 0.5 and 1.0 <= y <= 9.0 and 0 <= d <= 500:
            i, j = min(int((x + 2.0) / 0.5), 4), min(int((y - 1.0) / 2.0), 3)
            k = max(q for q in range(3) if zs[q] <= d)
            t = ((x + 2.0) / 0.5 - i, (y - 1.0) / 2.0 - j, (d - zs[k]) / (zs[k + 1] - zs[k]))
            corner = [(v[i + a, j + b, k + c], (t[0] if a else 1 - t[0]) * (t[1] if b else 1 - t[1]) * (t[2] if c else 1 - t[2])) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
            want = None if any(x is None for x, _ in corner) else sum(x * w for x, w in corner)
        assert (got[n] is None) == (want is None) and (want is None or math.isclose(got[n], want, abs_tol=1e-9))
    with pytest.raises(ValueError):
        interpolation.trilinear(frame, cube, g, "error")


def test_trilinear_over_uneven_and_deep_axes(spark):
    rng = random.Random(2)
    xs, ys = (-3.0, -2.9, 0.0, 10.0), (1.0, 4.0, 4.5)
    zs = tuple(np.cumsum([rng.choice([0.01, 1.0, 7.0]) for _ in range(10_000)]).tolist())
    g = grid.rectilinear(xs, ys, zs)
    assert g.extent == (-3.0, 1.0, 10.0, 4.5)
    f = lambda i, j, k: math.sin(i + 3 * j) * 5 + (k * 37 % 101)
    cube = spark.range(12 * 10_000).select((F.col("id") % 4).cast("int").alias("i"), (F.col("id") / 4 % 3).cast("int").alias("j"), F.floor(F.col("id") / 12).cast("int").alias("k"))
    cube = cube.withColumn("v", F.sin(F.col("i") + 3 * F.col("j")) * 5 + F.col("k") * 37 % 101)
    points = [(n, rng.uniform(-3.5, 11), rng.uniform(0.5, 5), rng.uniform(-10, zs[-1] + 10)) for n in range(300)] + [(1000 + k, -2.9, 4.0, zs[k]) for k in (0, 63, 64, 65, 128, 9_998, 9_999)] + [(2000, 10.0, 4.5, zs[-1]), (2001, None, 2.0, 1.0), (2002, 0.0, 2.0, None)]
    got = {r.id: r.tri for r in interpolation.trilinear(spark.createDataFrame(points, "id int, x double, y double, d double"), cube, g).collect()}
    nearest = {r.id: r.z for r in interpolation.nearest_depth(spark.createDataFrame(points, "id int, x double, y double, d double"), g).collect()}
    for n, x, y, d in points:
        assert nearest[n] == (None if d is None else min(zs, key=lambda z: (abs(z - d), z)))
        if x is None or d is None or not (xs[0] <= x <= xs[-1] and ys[0] <= y <= ys[-1] and zs[0] <= d <= zs[-1]):
            assert got[n] is None
            continue
        (i, tx), (j, ty), (k, tz) = ((b := min(max(int(np.searchsorted(a, c, "right")) - 1, 0), len(a) - 2), (c - a[b]) / (a[b + 1] - a[b])) for a, c in ((xs, x), (ys, y), (zs, d)))
        want = sum(f(i + a, j + b, k + c) * (tx if a else 1 - tx) * (ty if b else 1 - ty) * (tz if c else 1 - tz) for a in (0, 1) for b in (0, 1) for c in (0, 1))
        assert got[n] == pytest.approx(want, abs=1e-6)
    for bad in ((1.0,), (1.0, 1.0), (2.0, 1.0)):
        with pytest.raises(ValueError):
            grid.rectilinear(bad, ys, zs)


OWN = ("i", "j", "a00", "slab", "tri", "_i", "_k", "edge", "flag", "tile", "z", "bathy_dep", "v", "lon", "lat")


@pytest.mark.parametrize("act", ["trilinear", "clamp", "tile_flags", "sample"])
def test_own_columns_of_any_name_are_kept(spark, act):
    plain_points = spark.createDataFrame([(n, 0.5 * n, 1.0, 5.0, 1, n % 3, 7) for n in range(4)], "id int, x double, y double, d double, row int, col int, tile_id int")
    points = plain_points.withColumns({c: F.lit(f"own {c}") for c in OWN})
    cube = spark.createDataFrame([(i, j, k, float(i + j + k)) for i in range(3) for j in range(3) for k in range(2)], "i int, j int, k int, v double")
    g = Grid(3, 3, (0.0, 10.0))
    acts = {
        "trilinear": ("tri", lambda p: interpolation.trilinear(p, cube, g)), "clamp": ("tri", lambda p: interpolation.trilinear(p, cube, g, "clamp")),
        "tile_flags": ("flag", lambda p: interpolation.tile_flags(p, spark.createDataFrame([(7, True)], "tile_id int, edge boolean"), g)),
        "sample": ("bathy_dep", lambda p: grid.sample(p, spark.createDataFrame([(1, 0, 2.5)], "row int, col int, z double"), "z", "bathy_dep")),
    }
    new, run = acts[act]
    got, want = run(points), {r.id: r[new] for r in run(plain_points).collect()}
    assert sorted(got.columns) == sorted(points.columns) and {r.id: r[new] for r in got.collect()} == want
    assert all(r[c] == f"own {c}" for r in got.collect() for c in OWN if c != new)


def test_row_pad_case(spark):
    N = None
    rows = [[1, 2, N, 4], [N, N, N, N], [5, N, 7, N], [N, N, N, N]]
    cells = spark.createDataFrame([(0, i, j, None if x is None else float(x)) for i, r in enumerate(rows) for j, x in enumerate(r)], "k int, i int, j int, v double")
    got = {(r.i, r.j): r.v for r in interpolation.row_pad(cells).collect()}
    assert [got[i, j] for i in range(4) for j in range(4)] == [1, 2, 4, 4, 4.5, 4.5, 4.5, 4.5, 5, 7, 7, 7, 7, 7, 7, 7]


def test_interpolators_against_numpy(spark):
    rng = random.Random(3)
    samples = [(n, x, y, 3.0 * x - y * y) for n, (x, y) in enumerate((rng.uniform(0, 6), rng.uniform(0, 6)) for _ in range(60))]
    s = spark.createDataFrame(samples, "sid int, x double, y double, v double")
    t = s.select(F.col("sid").alias("id"), "x", "y")
    for f, tol in ((interpolation.idw, 1e-9), (interpolation.kriging, 1e-6), (interpolation.natural_neighbour, 1e-9), (interpolation.spline, 1e-6)):
        for leaf in (None, 5):
            got = {r.id: r.v for r in f(t, s, 10, leaf).collect()}
            assert all(abs(got[n] - v) <= tol for n, _, _, v in samples), f.__name__
    places = [(n, rng.uniform(0, 6), rng.uniform(0, 6)) for n in range(40)]
    at = spark.createDataFrame(places, "id int, x double, y double")
    model = (4.0, 2.0, 0.1)
    got = [{r.id: r.v for r in f.collect()} for f in (interpolation.idw(at, s, 8), interpolation.kriging(at, s, 8, model=model), interpolation.spline(at, s, 8, weight=0.3))]
    p = np.array([r[1:3] for r in samples])
    v = np.array([r[3] for r in samples])
    for n, x, y in places:
        d = np.hypot(*(p - (x, y)).T)
        near = np.argsort(d, kind="stable")[:8]
        h = np.hypot(*(p[near][:, None] - p[near][None]).transpose(2, 0, 1))
        g = lambda h: np.where(h > 0, 0.1 + 2.0 * (1.5 * np.minimum(h / 4, 1) - 0.5 * np.minimum(h / 4, 1) ** 3), 0)
        a = np.ones((9, 9))
        a[:8, :8], a[8, 8] = g(h), 0
        krig = np.linalg.solve(a, np.append(g(d[near]), 1))[:8] @ v[near]
        a[:8, :8] = interpolation.tension(h, 0.3)
        c = np.linalg.solve(a, np.append(v[near], 0))
        want = (v[near] / d[near] ** 2).sum() / (1 / d[near] ** 2).sum(), krig, interpolation.tension(d[near], 0.3) @ c[:8] + c[8]
        assert all(math.isclose(f[n], w, rel_tol=1e-6, abs_tol=1e-6) for f, w in zip(got, want))


def plain_natural(p, v, at):
    """Sibson's mean at a place by plain polygon cuts against all samples; None outside the hull."""
    first = {}
    for (x, y), z in zip(p, v):
        first.setdefault((x - at[0], y - at[1]), z)
    if (0.0, 0.0) in first:
        return first[0.0, 0.0]
    s, v = list(first), list(first.values())

    def cut(poly, a, b, c):
        out = []
        for (x, y), (x2, y2) in zip(poly, poly[1:] + poly[:1]):
            d, d2 = a * x + b * y - c, a * x2 + b * y2 - c
            if d <= 0:
                out.append((x, y))
            if (d <= 0) != (d2 <= 0):
                out.append((x + d / (d - d2) * (x2 - x), y + d / (d - d2) * (y2 - y)))
        return out

    for wide in (10.0**i for i in range(8)):
        cell = [(-wide, -wide), (wide, -wide), (wide, wide), (-wide, wide)]
        for x, y in s:
            cell = cut(cell, x, y, (x * x + y * y) / 2)
        if max(abs(c) for q in cell for c in q) < 0.99 * wide:
            break
    else:
        return None
    total = weight = 0.0
    for i, (x, y) in enumerate(s):
        part = cell
        for j, (x2, y2) in enumerate(s):
            if i != j and part:
                part = cut(part, x2 - x, y2 - y, (x2 * x2 + y2 * y2 - x * x - y * y) / 2)
        area = sum(a * d - b * c for (a, b), (c, d) in zip(part, part[1:] + part[:1])) / 2
        total, weight = total + area * v[i], weight + area
    return total / weight


def test_natural_neighbours_against_plain_cuts(spark):
    rng = random.Random(6)
    p = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(70)] + [(float(x), float(y)) for x in range(10, 14) for y in range(4)] + [(rng.gauss(3, 0.01), rng.gauss(3, 0.01)) for _ in range(30)]
    p += p[:5] + [(50.0, 40.0)]
    v = [rng.uniform(-5, 5) for _ in p]
    places = [(rng.uniform(-1, 14), rng.uniform(-1, 10)) for _ in range(60)] + [(11.5, 1.5), (11.0, 2.0), (40.0, 31.0), (12.25, 1.5), (9.5, 20.0)] + [(rng.gauss(3, 0.01), rng.gauss(3, 0.01)) for _ in range(10)]
    s = spark.createDataFrame([(i, *q, z) for i, (q, z) in enumerate(zip(p, v))], "sid long, x double, y double, v double").repartition(3)
    t = spark.createDataFrame([(i // 2, *q) for i, q in enumerate(places)] + [(1, None, 2.0)], "id long, x double, y double").repartition(2)  # ids repeat
    want = {q: plain_natural(p, v, q) for q in places}
    assert sum(x is None for x in want.values()) > 5
    for leaf in (8, 1000):
        got = interpolation.natural_neighbour(t, s, 10, leaf).collect()
        assert len(got) == len(places) + 1
        for r in got:
            w = want.get((r.x, r.y))
            assert (r.v is None) == (w is None) and (w is None or r.v == pytest.approx(w, abs=1e-9)), (r, w)
    plane = {(r.x, r.y): r.v for r in interpolation.natural_neighbour(t, s.withColumn("v", 2 * F.col("x") - 3 * F.col("y") + 1), 10, 8).collect() if r.v is not None}
    assert all(z == pytest.approx(2 * x - 3 * y + 1, abs=1e-7) for (x, y), z in plane.items()) and len(plane) > 40
    both = {(r.x, r.y): r.v for r in interpolation.natural_then_idw(t, s, 10, 8).collect()}
    weighed = {(r.x, r.y): r.v for r in interpolation.idw(t, s, 10, 8).collect()}
    assert all(both[q] == pytest.approx(weighed[q] if want[q] is None else want[q], abs=1e-9) for q in places)
    none = interpolation.natural_then_idw(t, s.where("sid < 0"), 10).collect()
    assert len(none) == len(places) + 1 and {r.v for r in none} == {None}


def test_natural_neighbours_solve_a_place_once(spark, monkeypatch):
    from abyssal.operators import natural, nearest

    held = {}
    keep = lambda df, name, write=nearest.written: held.setdefault(name, write(df, name))
    monkeypatch.setattr(nearest, "written", keep)
    monkeypatch.setattr(natural, "written", keep)
    s = spark.createDataFrame([(36 * n + 6 * i + j, float(i), float(j), 2.0 * i - j + 100 * n) for n in range(30) for i in range(6) for j in range(6)], "sid long, x double, y double, v double")
    places = [(0.5, 0.5), (2.25, 3.5), (4.0, 1.0), (7.0, 1.0)]
    t = spark.createDataFrame([(n, *q) for n, q in enumerate(places * 5)], "id long, x double, y double")
    got = {r.id: r.v for r in interpolation.natural_neighbour(t, s, 10).collect()}
    want = [0.5, 1.0, 7.0, None]
    assert len(got) == 20 and all(got[n] is None if want[n % 4] is None else got[n] == pytest.approx(want[n % 4]) for n in got)
    assert held["targets"].count() == 4 and held["samples"].count() == 36  # a row for each place
    assert held["natural"].where("need is not null and x < 6").count() == 0  # copies of near samples do not hide the others


def test_tension_basis():
    # K0(1) = 0.42102, K0(0.1) = 2.42707
    for x, k0 in ((1.0, 0.4210244382), (0.1, 2.4270690247)):
        assert interpolation.tension(np.array([x]), 1.0)[0] == pytest.approx(-(math.log(x / 2) + 0.5772156649 + k0) / (2 * math.pi), abs=1e-8)


def test_solvers_take_a_place_once(spark, monkeypatch):
    from abyssal.operators import nearest

    held = []
    monkeypatch.setattr(nearest, "written", lambda df, name, write=nearest.written: held.append((name, write(df, name))) or held[-1][1])
    rng = random.Random(12)
    spots = [(rng.uniform(0, 5), rng.uniform(0, 5)) for _ in range(30)]
    s = spark.createDataFrame([(n, *spots[n % 30], n % 7 + 0.5) for n in range(90)], "sid int, x double, y double, v double")
    t = spark.createDataFrame([(n, *[(1.5, 2.0), (3.25, 3.0)][n % 2]) for n in range(40)], "id int, x double, y double")
    for f in (interpolation.spline, interpolation.idw):
        del held[:]
        got = {r.id: r.v for r in f(t, s, 9).collect()}
        assert len(got) == 40 and len(set(got.values())) == 2
        assert dict(held)["targets"].count() == 2


def test_systems_of_samples_at_one_place():
    rng = np.random.default_rng(8)
    p, v = rng.uniform(0, 3, (6, 2)), rng.normal(0, 1, 6)
    p[3] = p[1]
    parts = list(interpolation._merged(np.stack([p, rng.uniform(0, 3, (6, 2))]), np.stack([v, v])))
    assert [(r.tolist(), q.shape, z.shape) for r, q, z in parts] == [([0], (1, 5, 2), (1, 5)), ([1], (1, 6, 2), (1, 6))]
    # the least-norm solution of the whole system gives the same value
    a = np.ones((7, 7))
    a[:6, :6], a[6, 6] = interpolation.tension(interpolation._apart(p[None])[0], 0.1), 0
    c = np.linalg.pinv(a) @ np.append(v, 0)
    own, mean = parts[0][1][0], parts[0][2][0]
    b = np.ones((6, 6))
    b[:5, :5], b[5, 5] = interpolation.tension(interpolation._apart(own[None])[0], 0.1), 0
    e = interpolation._linear(b[None], np.append(mean, 0)[None])[0]
    at = np.array([1.0, 2.0])
    far = lambda q: interpolation.tension(np.hypot(*(q - at).T), 0.1)
    assert far(p) @ c[:6] + c[6] == pytest.approx(far(own) @ e[:5] + e[5], abs=1e-9)
    one = np.eye(3)
    both = interpolation._linear(np.stack([one * 2, np.ones((3, 3)), one]), np.ones((3, 3)))  # a singular one among others
    assert np.allclose(both, [[0.5] * 3, [1 / 3] * 3, [1] * 3])
    for x in (1e-7, 1e-3, 0.5, 1.9999, 2.0001, 5.0, 40.0):  # by the integral on a fine net
        t = np.linspace(0, 24, 4801)
        y = np.exp(-np.minimum(x * np.cosh(t), 700))
        k0 = 0.005 * (y.sum() - y[0] / 2 - y[-1] / 2)
        assert interpolation.tension(np.array([x]), 1.0)[0] == pytest.approx(-(math.log(x / 2) + 0.5772156649015329 + k0) / (2 * math.pi), rel=1e-9, abs=1e-13)


def test_variogram_is_fitted(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 20, (1500, 2))
    waves = rng.normal(0, 1, (200, 2)) * 0.6
    v = np.sign(np.cos(p @ waves.T + rng.uniform(0, 6.3, 200))).sum(1) / 14  # steps, so that it rises from the origin in a line
    s = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, ((x, y), z) in enumerate(zip(p, v))], "sid long, x double, y double, v double")
    span, sill, nugget = interpolation.variogram(s, 3.0)
    # half the mean squared differences of all pairs at that distance
    d, g = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)), (v[:, None] - v[None]) ** 2 / 2
    for h in (0.5, 0.9, 1.2):
        assert interpolation.spherical(np.array([h]), span, sill, nugget)[0] == pytest.approx(g[abs(d - h) < 0.05].mean(), abs=0.06)
    flat = interpolation.variogram(s.withColumn("v", F.lit(1.0)))
    assert all(math.isfinite(x) for x in flat)


def test_lag_sums_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.uniform(0, 10, (150, 2)), rng.normal(4, 0.01, (100, 2)), np.full((20, 2), 2.5)])
    v = rng.normal(0, 1, len(p))
    s = spark.createDataFrame([(i % 9, float(x), float(y), float(z)) for i, ((x, y), z) in enumerate(zip(p, v))] + [(1, 3.0, 3.0, None), (2, None, 1.0, 1.0)], "sid long, x double, y double, v double").repartition(3)
    d, g = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)), (v[:, None] - v[None]) ** 2 / 2
    i, j = np.triu_indices(len(p), 1)
    d, g = d[i, j], g[i, j]
    some = (d > 0) & (d <= 2.5)
    lag = np.minimum((d[some] / 2.5 * 5).astype(int), 4)
    want = [(d[some][lag == k].sum(), g[some][lag == k].sum(), int((lag == k).sum())) for k in range(5)]
    for leaf in (6, 1000):
        got = interpolation.lag_sums(s, 2.5, 5, leaf)
        assert [x[2] for x in got] == [x[2] for x in want]
        assert np.allclose([x[:2] for x in got], [x[:2] for x in want])


def test_variogram_sends_places_not_samples(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(interpolation, "written", lambda df, name, write=interpolation.written: held.setdefault(name, write(df, name)))
    rng = np.random.default_rng(2)
    p, v = rng.integers(0, 40, (3000, 2)) / 4, rng.normal(50, 1, 3000)
    s = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, ((x, y), z) in enumerate(zip(p, v))], "sid long, x double, y double, v double")
    i, j = np.triu_indices(len(p), 1)
    d, g = np.hypot(*(p[i] - p[j]).T), (v[i] - v[j]) ** 2 / 2
    some = (d > 0) & (d <= 2.3)
    lag = np.minimum((d[some] * (5 / 2.3)).astype(int), 4)
    got = interpolation.lag_sums(s, 2.3, 5, 4)
    assert [x[2] for x in got] == np.bincount(lag, minlength=5).tolist()
    assert np.allclose([x[0] for x in got], np.bincount(lag, d[some])) and np.allclose([x[1] for x in got], np.bincount(lag, g[some]))
    assert held["variogram_places"].count() == len(np.unique(p, axis=0)) < 1601 and held["variogram_leaves"].count() <= 2 * 64


def test_nearest_where_samples_are_dense_equal_or_absent(spark):
    rng = random.Random(4)
    places = [(rng.uniform(0, 5), rng.uniform(0, 5)) for _ in range(80)] + [(2.0, 2.0)] * 60 + [(rng.gauss(1, 0.001), 1.0) for _ in range(60)] + [(float(x), float(y)) for x in range(4) for y in range(4)]
    data = [(i * 7 % 1000, x, y, float(i)) for i, (x, y) in enumerate(places)] + [(5, None, 1.0, 1.0), (6, math.nan, 1.0, 1.0)]
    s = spark.createDataFrame(data, "sid int, x double, y double, v double").repartition(3)
    at = [(rng.uniform(-1, 6), rng.uniform(-1, 6)) for _ in range(40)] + [(2.0, 2.0), (1.5, 1.5), (200.0, -300.0), (1.0, 1.0)]
    t = spark.createDataFrame([(i % 3, *q) for i, q in enumerate(at)] + [(0, None, None)], "id int, x double, y double").repartition(2)  # ids repeat
    for n in (1, 5, 300):
        want = {q: [(x[0]) for x in sorted((r for r in data if r[1] is not None and r[1] == r[1]), key=lambda r: ((q[0] - r[1]) * (q[0] - r[1]) + (q[1] - r[2]) * (q[1] - r[2]), r[0]))[:n]] for q in at}
        for leaf in (3, None):
            got = interpolation.nearest(t, s, n, leaf).collect()
            assert len(got) == len(at) + 1
            for r in got:
                assert [e.sid for e in r.near] == want.get((r.x, r.y), []), (n, leaf, r.x, r.y)
    none = interpolation.neighbours(t, s.where("sid < 0"), 5)
    assert none.columns == ["id", "x", "y", "sid", "sx", "sy", "sv", "d2", "rank"] and none.count() == 0
    assert {r.v for r in interpolation.idw(t, s.where("sid < 0"), 5).collect()} == {None}
    twice = spark.createDataFrame([(1, 2.0, 2.1), (1, 4.0, 4.1)], "id int, x double, y double")  # rows of one id have values of their own
    alone = [r.v for i in (0, 1) for r in interpolation.idw(twice.where(f"x = {2 + 2 * i}"), s, 5).collect()]
    assert sorted(r.v for r in interpolation.idw(twice, s, 5).collect()) == sorted(alone) and alone[0] != alone[1]


def test_tile_counts():
    assert [tiling.tile_count(n) for n in (998, 999, 1998, 4000, 21600, 43200)] == [2, 6, 10, 14, 22, 26]
    assert 86400 / tiling.tile_count(86400) <= 2000 and tiling.tile_count(86400) == 60  # 30 tiles would have 2,880 cells a side
    assert tiling.is_small(998, 998) and tiling.is_small(50, 100) and not tiling.is_small(5000, 100)


def test_mosaic_of_tiles_is_the_raster(spark):
    raster = spark.createDataFrame([(r, c, float(r * 7 - c)) for r in range(12) for c in range(10)], "row int, col int, z double")
    tiles = tiling.tile_assign(raster, 12, 10, 3, 2)
    parts = [tiles.where(F.col("tile_id") == i) for i in range(6)]
    assert sorted(map(tuple, tiling.mosaic(parts).collect())) == sorted(map(tuple, raster.collect()))
    assert sorted(map(tuple, tiling.mirror(tiling.mirror(raster, 10), 10).select("row", "col", "z").collect())) == sorted(map(tuple, raster.collect()))


def test_bins_and_rounding(spark):
    edges = [-15000, -10000, -50, 0]
    got = [r.b for r in spark.createDataFrame([(float(x),) for x in (-15000, -10000, -9999, -50, 0, 1)], "d double").select(R.depth_bin(F.col("d"), edges).alias("b")).collect()]
    assert got == [None, -10000, -50, -50, 0, None]


def test_layer_catalog_strips_the_prefix(spark):
    got = grid.layer_catalog(spark.createDataFrame([("b1oam10",), ("b1oam0",), ("other",)], "name string"), "b1oam").collect()
    assert sorted(r.depth_m for r in got) == [0, 10]
    with pytest.raises(ValueError):
        grid.require_layers(spark.createDataFrame([("a",)], "name string"))


def test_depth_extend_cases(spark):
    layers = spark.createDataFrame([(10.0, 0, 0, 1.0), (5500.0, 0, 0, 2.0)], "depth double, i int, j int, v double")
    deep = sorted((r.depth, r.v) for r in preflight.depth_extend(layers, 0.0, 6000.0).collect())
    assert deep == [(0.0, 1.0), (10.0, 1.0), (5500.0, 2.0), (5501.0, 2.0), (6100.0, 2.0)]
    assert sorted(r.depth for r in preflight.depth_extend(layers, 5.0, 100.0).collect()) == [4.0, 10.0, 5500.0]


def test_cast_files(spark):
    text = "#--,\nCAST,,7,\nLatitude,,1.5,\nLongitude,,-2,\nVARIABLES,Depth,F,O,Temperatur,F,O\nProf-Flag,,0\n" + "".join(f"{i},{i * 10},0,0,{20 - i}.5,0,0\n" for i in range(1, 11)) + "END OF VARIABLES\n#--,\nCAST,,8,\nLatitude,,x,\nVARIABLES,Depth,F\nProf-Flag\n1,---0---,0\nEND\n"
    parsed = casts.parse(spark.createDataFrame([("f", text)], "path string, text string"))
    levels = casts.coerce(casts.variables(parsed, ["Depth", "Temperatur"]), ["Depth", "Temperatur"])
    got = {r.cast: r for r in casts.deepest(levels).collect()}
    assert (got["7"].level, got["7"].Depth, got["7"].Temperatur, got["7"].lat) == (10, 100.0, 10.5, 1.5)
    assert (got["8"].level, got["8"].Depth, got["8"].Temperatur, got["8"].lat) == (1, None, None, None)
    assert {r.name for r in casts.variable_names(parsed).collect()} == {"Depth", "Temperatur"}


def test_depth_filter_without_bathymetry(spark):
    points = spark.createDataFrame([(-90.0, -100.0), (-90.0, 0.0), (-90.0, None)], "depth double, bathy_dep double")
    assert validation.depth_filter(points, 0.2).count() == 1


def test_validation_sign_and_sets(spark):
    rows = [(i, -100.0, -100.0 if i < 6 else -400.0, 12.0 + i % 2, 10.0, 1) for i in range(8)] + [(8, -100.0, -100.0, None, 10.0, 1), (9, -100.0, 0.0, 11.0, None, 1)]
    rows.append((10, -100.0, None, 99.0, 1.0, 1))  # no bathymetry: in no statistic
    points = spark.createDataFrame(rows, "id int, depth double, bathy_dep double, obs double, tri double, cell int")
    assert validation.statistics(points).first().mean_diff == 2.5  # observed above the estimate
    assert tuple(validation.retained(points, 0.5).first()) == (9, 6, 3)
    got = {r.variant: r for r in validation.summary(points, 0.5).collect()}
    assert (got["original"].n, got["filtered"].n, got["original"].mean_diff, got["filtered"].depth_rmse) == (8, 6, 2.5, 0.0)
    assert validation.with_bathymetry(points).count() == 10 and tuple(validation.scatter_limits(points).first()) == (10.0, 13.0)
    kept = validation.depth_filter(points, 0.5)
    assert [(r.bin, r.n, r.mean_diff) for r in validation.depth_bins(kept).where("n > 0").collect()] == [(-100, 6, 2.5)]
    box = validation.boxplot(kept).first()
    assert (box.q1, box.median, box.q3, box.low, box.high, box.n_fliers) == (2.0, 2.5, 3.0, 2.0, 3.0, 0)
    assert "filtered" in validation.report(validation.summary(points, 0.5), "x")
    assert validation.observed_variable("sal") == ("Salinity", "unitless")
    with pytest.raises(ValueError):
        validation.observed_variable("ph")


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(2)
    data = [(int(g), float(x)) for g, n in ((1, 1), (2, 2), (3, 500), (4, 37)) for x in (np.round(rng.normal(0, 5, n), 1) if g < 4 else np.full(n, 7.0))]
    got = {r.g: r.q for r in validation.quantiles(spark.createDataFrame(data, "g int, x double"), "g", "x", [0.0, 0.25, 0.5, 0.9], 16).collect()}
    for g in (1, 2, 3, 4):
        assert got[g] == pytest.approx(np.quantile([x for k, x in data if k == g], [0.0, 0.25, 0.5, 0.9]).tolist())


def test_cast_directory_round_trip(spark, tmp_path):
    from abyssal.sources import ctd

    head = "#--,\nCAST,,{},\nLatitude,,{},\nLongitude,,-2,\nVARIABLES,Depth,F,O,Temperatur,F,O\nProf-Flag,,0\n"
    (tmp_path / "a.csv").write_text(head.format(7, 1.5) + "1,10,0,0,3.5,0,0\n2,20,0,0,---0---,0,0\nEND\n" + head.format(8, 2.5) + "END\n")
    (tmp_path / "b.csv").write_text(head.format(7, 1.5) + "1,5,0,0,1.5,0,0\nEND\n" + head.format(9, 1.5) + "1,50,0,0,2.5,0,0\nEND\n" + head.format(10, 1.5) + "1,50,0,0,7,0,0\nEND\n")
    done, counts = ctd.cleaned(*ctd.scan(spark, str(tmp_path)), ["Depth", "Temperatur"])
    # equal numbers in two files are two casts; of a file's casts at one place the deepest stays, the first of equals
    assert tuple(counts.first()) == (5, 1)
    ctd.write_casts(done, str(tmp_path / "out"))
    back = ctd.read_casts(spark, str(tmp_path / "out"), done.schema.simpleString()[7:-1].replace(":", " "))
    assert {(r.path[-5:], r.cast_no, r.cast, r.level, r.Depth, r.Temperatur) for r in back.collect()} == {("a.csv", 1, "7", 2, -20.0, None), ("b.csv", 2, "9", 1, -50.0, 2.5)}


@pytest.fixture
def cut_at(spark):
    """Cuts files into blocks of so many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": None}
    for k in keys:
        keys[k] = spark.conf.get(k)

    def at(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield at
    for k, v in keys.items():
        spark.conf.set(k, v)


def test_casts_are_the_same_wherever_files_are_cut(spark, tmp_path, cut_at):
    from abyssal.sources import ctd

    rng = random.Random(4)
    for f in range(3):
        lines = ["stray,1,2", "END before any"]
        for c in range(6):
            lines += ["#--------", *rng.sample([f"CAST,,{c % 5},", f"Latitude,, {c}.5 ,", "Longitude,,3", "VARIABLES,Depth,F,O,Oxygen,F,O"], rng.randint(2, 4)), *["Prof-Flag,,0"] * (c % 6 > 0)]
            lines += [f"{k + 1}, {k * 10} ,0,0,{rng.choice(['---0---', '2.5', ''])},0,0" for k in range(rng.randint(0, 6))] + [""] * (c % 4 == 1) + ["CAST,,99,"] * (c % 5 == 2)
            lines += ["END OF VARIABLES", "CAST,,77,", "9,9,9"] * (c % 3 > 0)
        (tmp_path / f"cruise {f}.csv").write_text(("\r\n" if f == 2 else "\n").join(lines) + ("\n" if f else ""))
    seen = []
    for n in (1 << 20, 300, 53):
        cut_at(n)
        levels, counts = ctd.scan(spark, str(tmp_path))
        seen.append((plain(map(tuple, levels.withColumns({"names": F.col("names").cast("string"), "fields": F.col("fields").cast("string")}).collect())), plain(map(tuple, counts.collect()))))
    assert len(seen[0][0]) > 20 and [c for _, c in seen[0][1]] == [6] * 3
    assert seen[1] == seen[0] and seen[2] == seen[0]


def test_grids_are_the_same_wherever_files_are_cut(spark, tmp_path, cut_at):
    rng = np.random.default_rng(3)
    z = np.round(rng.normal(0, 100, (4, 6)), 3)
    z[rng.random(z.shape) < 0.2] = -9999
    head = "ncols 6\nnrows 4\nxllcorner -10\nyllcorner 5.5\ncellsize 0.5\nNODATA_value -9999\n"
    bodies = {"rows": "\n".join(" ".join(map(str, r)) for r in z), "one line": " ".join(map(str, z.reshape(-1))) + " ", "returns": "\r\n".join(" ".join(map(str, r)) for r in z) + "\r\n"}
    for name, body in bodies.items():
        (tmp_path / f"{name}.asc").write_text(head + body)
    (tmp_path / "centre.asc").write_text("NCOLS 2\nNROWS 1\nXLLCENTER 1\nYLLCENTER 2\nCELLSIZE 4\n-9999 x 8 9")
    (tmp_path / "empty.asc").write_text("")
    (tmp_path / "other.asc").write_text("no grid at all")
    for n in (1 << 20, 90, 31):
        cut_at(n)
        got = aaigrid.read_grids(spark, str(tmp_path)).collect()
        for name in bodies:
            mine = {(r.row, r.col): (r.x, r.y, r.z) for r in got if r.path.endswith(f"{name}.asc")}
            assert mine == {(i, j): (-9.75 + 0.5 * j, 5.75 + 0.5 * (3 - i), None if z[i, j] == -9999 else z[i, j]) for i in range(4) for j in range(6)}, (n, name)
        assert {(r.col, r.x, r.y, r.z) for r in got if "centre" in r.path} == {(0, 1.0, 2.0, None), (1, 5.0, 2.0, None)}
        assert len(got) == 3 * 24 + 2


def test_a_grid_in_parts_is_one_grid(spark, tmp_path, cut_at):
    data = [(r, c, float(r * 10 + c) if (r + c) % 4 else None) for r in range(11) for c in range(6) if r != 5 and c != 3] + [(20, 1, 1.0), (0, 9, 1.0)]
    raster = spark.createDataFrame(data, "row int, col int, z double")
    want = {(r, c): None for r in range(11) for c in range(6)} | {(r, c): z for r, c, z in data if r < 11 and c < 6}
    for parts in (1, 4):
        path = str(tmp_path / f"grid {parts}")
        aaigrid.write_grid(raster, path, 11, 6, 2.0, 3.0, 0.5, parts=parts)
        files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
        lines = "".join(open(f"{path}/{f}").read() for f in files).splitlines()
        assert lines[:3] == ["ncols 6", "nrows 11", "xllcorner 2.0"] and len(lines) == 17 and {len(x.split()) for x in lines[6:]} == {6}
        cut_at(120)
        assert {(r.row, r.col): r.z for r in aaigrid.read_grids(spark, path, parts=True).collect()} == want


def test_pearson_p():
    assert validation.pearson_p(0.0, 10) == pytest.approx(1.0)
    assert validation.pearson_p(0.5, 20) == pytest.approx(0.0247, abs=2e-4)


def test_projection_round_trip(spark):
    at = spark.createDataFrame([(float(lon), float(lat)) for lon in (-179, 0, 33) for lat in (-80, -1, 0, 45, 85)], "lon double, lat double")
    x, y = R.mercator(F.col("lon"), F.col("lat"))
    lon, lat = R.inverse_mercator(F.col("x"), F.col("y"))
    for r in at.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.lon - r.a) < 1e-10 and abs(r.lat - r.b) < 1e-10
    wide = spark.createDataFrame([(float(lon), float(lat)) for lon in (-179, 0, 33) for lat in (-90, -89.999, -80, -1, 0, 1e-9, 45, 85, 89.9, 90)], "lon double, lat double")
    bx, by = R.behrmann(F.col("lon"), F.col("lat"))
    lon, lat = R.inverse_behrmann(F.col("x"), F.col("y"))
    for r in wide.select("lon", "lat", bx.alias("x"), by.alias("y")).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.lon - r.a) < 1e-9 and abs(r.lat - r.b) < (1e-9 if abs(r.lat) < 89.99 else 1e-4), r
    beyond = spark.createDataFrame([(0.0, 9e6), (0.0, -9e6), (None, None)], "x double, y double").select(*R.inverse_behrmann(F.col("x"), F.col("y")))
    assert [r[1] for r in beyond.collect()] == [None] * 3


def test_grid_files_round_trip(spark, tmp_path):
    raster = spark.createDataFrame([(r, c, None if r == c else float(r * 10 + c), 0) for r in range(4) for c in range(3)], "row int, col int, z double, tile_id int")
    aaigrid.write_grids(raster, str(tmp_path / "g"))
    got = {(r.row, r.col): r.z for r in aaigrid.read_grids(spark, str(tmp_path / "g" / "tile_id=0")).collect()}
    assert got == {(r.row, r.col): r.z for r in raster.collect()}
    points = spark.createDataFrame([(1.0, 2.0, None), (3.0, 4.0, 5.0)], "y double, x double, z double")
    aaigrid.write_yxz(points, str(tmp_path / "p"))
    assert sorted(map(str, aaigrid.read_yxz(spark, str(tmp_path / "p")).collect())) == sorted(map(str, points.collect()))


def test_stream_equals_batch(spark, tmp_path):
    from abyssal.plans.fixtures import GRID, load
    from abyssal.streaming.tiles import interpolate_stream

    points, cube = load(spark, DATA, "bathy"), load(spark, DATA, "cube")
    points.write.parquet(str(tmp_path / "in"))
    run = interpolate_stream(spark, str(tmp_path / "in"), "id long, x double, y double, d double", cube, GRID, str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination(120)
    want = interpolation.trilinear(points, cube, GRID)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_nearest_outside_the_first_ring(spark):
    s = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 100.0, 0.0, 2.0)], "sid int, x double, y double, v double")
    t = spark.createDataFrame([(5, 40.0, 0.0)], "id int, x double, y double")
    assert [r.sid for r in interpolation.neighbours(t, s, 1, 1).collect()] == [0]


def odd(rings, x, y):
    """Even-odd by the definition, over all rings."""
    hit = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if y0 > y1:
                x0, y0, x1, y1 = x1, y1, x0, y0
            if y0 <= y < y1 and x0 + (y - y0) / (y1 - y0) * (x1 - x0) > x:
                hit = not hit
    return hit


def test_polygons_against_the_definition(spark):
    rng = random.Random(9)
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    star = [(5 + math.cos(a / 20 * math.pi) * rng.uniform(1, 4), 5 + math.sin(a / 20 * math.pi) * rng.uniform(1, 4)) for a in range(40)]
    shapes = {1: [[square(0, 0, 4), square(1, 1, 2)]], 2: [[star]], 3: [[square(4, 0, 4)], [square(9, 9, 1), square(9.25, 9.25, 0.5)]], 4: [[square(0, 4, 4)]], 5: [[[(2, 2), (2, 2), (2, 2)]]]}
    text = lambda ring: "(" + ", ".join(f"{x} {y}" for x, y in ring + ring[:1]) + ")"
    wkt = [(i, ("MULTIPOLYGON (" if len(parts) > 1 else "POLYGON ") + ", ".join("(" + ", ".join(map(text, p)) + ")" for p in parts) + (")" if len(parts) > 1 else "")) for i, parts in shapes.items()]
    frame = spark.createDataFrame(wkt + [(6, None), (7, "POLYGON EMPTY"), (8, "POINT (1 1)"), (9, "")], "id long, wkt string").repartition(3)
    rings = {i: [r for p in parts for r in p] for i, parts in shapes.items()}
    spec = grid.Spec(-1.0, -1.0, 11.0, 11.0, 0.25)
    want = {}
    for r in range(48):
        for c in range(48):
            hit = [i for i in rings if odd(rings[i], -0.875 + 0.25 * c, 11 - 0.125 - 0.25 * r)]
            if hit:
                want[r, c] = min(hit)
    assert {(r.row, r.col): r.id for r in polygons.to_raster(frame, spec).collect()} == want
    places = [(rng.uniform(-1, 11), rng.uniform(-1, 11)) for _ in range(300)] + [(float(x), float(y)) for x in range(-1, 11) for y in range(-1, 11)] + [(None, 1.0), (50.0, 50.0)]
    points = spark.createDataFrame([(n % 50, *p, "own") for n, p in enumerate(places)], "id int, x double, y double, polygon string").repartition(2)  # ids repeat
    expected = sorted((str(p), i) for p in places for i in ([k for k in rings if p[0] is not None and odd(rings[k], *p)] or [-1]))
    for net in (None, 1, 7, 60):
        got = polygons.within(points, frame, net=net).collect()
        assert sorted((str((r.x, r.y)), -1 if r.polygon is None else r.polygon) for r in got) == expected, net
    sizes = {r.id: (r.area, r.length) for r in polygons.measures(frame).collect()}
    assert sizes[1] == (12.0, 24.0) and sizes[3] == (16.75, 22.0) and sizes[5] == (0.0, 0.0) and set(sizes) == set(shapes)
    assert polygons.within(points, frame.where("id > 5")).where("polygon is not null").count() == 0 and polygons.to_raster(frame.where("id > 5"), spec).count() == 0


def test_equal_polygons_and_places_are_met_once(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(polygons, "written", lambda df, name, write=polygons.written: held.setdefault(name, write(df, name)))
    frame = spark.createDataFrame([(n, f"POLYGON (({n % 2} 0, 4 0, 4 4, {n % 2} 4))") for n in range(40)], "id long, wkt string")
    points = spark.createDataFrame([(n, [0.5, 2.0, 9.0][n % 3], 1.0) for n in range(60)], "no long, x double, y double")
    got = polygons.within(points, frame)
    ids = {0.5: list(range(0, 40, 2)), 2.0: list(range(40)), 9.0: [None]}
    assert sorted((r.no, r.polygon) for r in got.where("x < 9").collect()) == sorted((n, i) for n in range(60) for i in ids[[0.5, 2.0, 9.0][n % 3]] if i is not None)
    assert got.where("x = 9").count() == 20 and got.where("x = 9 and polygon is null").count() == 20
    assert (held["edges"].count(), held["places"].count()) == (8, 2)
    # rows made by an explode are joined by sorting: Spark takes them for small, and would send them all through the driver
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = polygons.within(points, frame)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("SortMergeJoin") == 3 and plan.count("BroadcastHashJoin") <= 1


def test_a_broken_run_goes_on_without_repeats_or_gaps(spark, tmp_path, monkeypatch):
    from abyssal.streaming import tiles

    g = Grid(4, 4, (0.0, 10.0))
    cube = spark.createDataFrame([(i, j, k, float(i + 2 * j + k)) for i in range(4) for j in range(4) for k in range(2)], "i int, j int, k int, v double")
    schema = "id long, x double, y double, d double, tile_id int"
    rows = [(t * 10 + n, 0.5 * t + 0.1 * n, 1.0, None if n == 3 else 4.0, t) for t in range(8) for n in range(4)]  # tiles from 6 on leave the grid
    for t in range(8):
        spark.createDataFrame([r for r in rows if r[4] == t], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start = lambda edges="fail": tiles.run_tiles(spark, str(tmp_path / "in"), schema, cube, g, str(tmp_path / "out"), str(tmp_path / "state"), edges, files=3)
    calls, commit, write = [], tiles._committed, tiles._tiles_written

    def breaks(*a):
        calls.append(a[2])
        if len(calls) == 2:
            raise RuntimeError("lost before the commit")
        commit(*a)

    monkeypatch.setattr(tiles, "_committed", breaks)
    with pytest.raises(Exception, match="lost before the commit"):
        start().awaitTermination(120)
    assert tiles.manifest(spark, str(tmp_path / "out")).count() == 3 and tiles.results(spark, str(tmp_path / "out")).count() == 12
    start().awaitTermination(120)
    spark.createDataFrame([r for r in rows if r[4] == 2], schema).write.mode("append").parquet(str(tmp_path / "in"))  # delivered again
    start().awaitTermination(120)
    want = tiles.interpolated(spark.createDataFrame(rows, schema), cube, g, "fail")
    got = tiles.results(spark, str(tmp_path / "out")).select(*want.columns)
    assert plain(map(tuple, got.collect())) == plain(map(tuple, want.collect())) and got.count() == 32
    assert {(r.tile_id, r.failed) for r in tiles.manifest(spark, str(tmp_path / "out")).collect()} == {(t, t >= 6) for t in range(8)}
    assert {(r.tri, r.flag) for r in got.where("tile_id >= 6").collect()} == {(100000.0, "Flag 5")}
    assert {r.flag for r in got.where("tile_id < 6").collect()} == {"Flag 2", "Flag 3"}


def test_plots_are_pixels(spark, tmp_path):
    import struct
    import zlib

    from abyssal.operators import plots

    points = spark.createDataFrame([(0.0, 0.0), (0.0, 0.1), (9.99, 10.0), (10.0, 10.0), (5.0, None), (float("nan"), 1.0)], "a double, b double")
    assert {tuple(r) for r in plots.scatter_pixels(points, "a", "b", 10).collect()} == {(0, 0, 2), (9, 9, 2)}
    assert {tuple(r) for r in plots.scatter_pixels(points, "a", "b", 10, (0, 5)).collect()} == {(0, 0, 2)}
    assert {tuple(r) for r in plots.scatter_pixels(points.where("a = 0 and b = 0"), "a", "b").collect()} == {(0, 0, 1)}
    assert plots.scatter_pixels(points.where("a > 99"), "a", "b").count() == 0
    raster = spark.createDataFrame([(r, c, float(r)) for r in range(4) for c in range(6)] + [(0, 0, None)], "row int, col int, z double")
    assert {tuple(r) for r in plots.raster_pixels(raster, 4, 6, 3).collect()} == {(x, y, 2.5 - 2 * y) for x in range(3) for y in range(2)}
    path = tmp_path / "a" / "plot.png"
    plots.save_png(plots.scatter_pixels(points, "a", "b", 10), str(path), 10, 10)
    data = path.read_bytes()
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (10, 10)
    at = data.index(b"IDAT")
    body = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    assert len(body) == 110 and body[1 + 9] != 255 and body[99 + 1] != 255 and body.count(255) == 98


def test_geotiffs_round_trip_and_windows(spark, tmp_path):
    import struct

    from abyssal.sources import geotiff

    rng = np.random.default_rng(5)
    z = np.round(rng.normal(0, 100, (70, 45)), 3)
    z[rng.random(z.shape) < 0.2] = np.nan
    f = geotiff.File(geotiff.encode(z, -10.0, 20.0, 0.5, side=16))
    got = np.full(z.shape, -1.0)
    for r, c, v in f.blocks():
        got[r, c] = v
    assert np.array_equal(got, z, equal_nan=True) and (f.left, f.top, f.dx, f.nodata, f.read) == (-10.0, 20.0, 0.5, -9999.0, 15)
    f.read = 0
    part = {(r, c): v for rr, cc, vv in f.blocks((17, 20, 10, 8)) for r, c, v in zip(rr.tolist(), cc.tolist(), vv.tolist())}
    assert f.read == 1 and set(part) == {(r, c) for r in range(17, 27) for c in range(20, 28)}
    # strips of short integers in the other byte order, as other writers leave them
    whole = np.arange(12, dtype=">i2").reshape(4, 3)
    tags = [(256, 3, 3), (257, 3, 4), (258, 3, 16), (259, 3, 1), (273, 4, 8 + 2 + 12 * 8 + 4), (277, 3, 1), (279, 4, 24), (339, 3, 2)]
    plain_tiff = b"MM\0*" + struct.pack(">IH", 8, len(tags)) + b"".join(struct.pack(">HHIHH", t, k, 1, v, 0) if k == 3 else struct.pack(">HHII", t, k, 1, v) for t, k, v in tags) + struct.pack(">I", 0) + whole.tobytes()
    other = np.zeros((4, 3))
    for r, c, v in geotiff.File(plain_tiff).blocks():
        other[r, c] = v
    assert (other == whole).all()
    cells = [(t, r, c, None if (r + c) % 5 == 0 else float(t * 100 + r * 10 + c)) for t in (3, 4) for r in range(2, 9) for c in range(4 * t, 4 * t + 4) if (r, c) != (5, 13)]
    geotiff.write_tiles(spark.createDataFrame(cells + cells[:2], "tile_id int, row int, col int, z double"), str(tmp_path / "g"), 100.0, 50.0, 2.0)
    back = geotiff.read_tiles(spark, str(tmp_path / "g")).collect()
    want = {(100.0 + 2 * (c + 0.5), 50.0 - 2 * (r + 0.5)): z for _, r, c, z in cells} | {(127.0, 39.0): None}
    assert {(r.x, r.y): r.z for r in back} == want and len(back) == 56
    assert geotiff.read_tiles(spark, str(tmp_path / "g"), (0, 0, 2, 3)).count() == 12
    (tmp_path / "g" / "no.tif").write_bytes(b"no tiff at all")
    with pytest.raises(Exception, match="not a GeoTIFF"):
        geotiff.read_tiles(spark, str(tmp_path / "g")).collect()


def test_points_travel_with_one_copy_of_their_place(spark):
    frame = spark.createDataFrame([(1, "POLYGON ((0 0, 4 0, 4 4, 0 4))")], "id long, wkt string")
    data = [(7, 1.0, 1.0, "a"), (8, 9.0, None, "b"), (9, -0.0, 2.0, "c")]
    points = spark.createDataFrame(data, "no long, x double, y double, polygon string")
    got = polygons.within(points, frame)
    assert got.columns == ["no", "x", "y", "polygon"] and {tuple(r) for r in got.collect()} == {(7, 1.0, 1.0, 1), (8, 9.0, None, None), (9, -0.0, 2.0, 1)}
    plan = got._jdf.queryExecution().analyzed().toString()
    (held,) = set(re.findall(r"struct\([^)]*\) AS row#", plan))
    assert "x#" not in held and "y#" not in held, held
    assert {tuple(r) for r in polygons.within(points.select("x", "y"), frame).collect()} == {(1.0, 1.0, 1), (9.0, None, None), (-0.0, 2.0, 1)}
    whole = points.selectExpr("no", "cast(x as int) as x", "cast(y as decimal(9,2)) as y")
    assert dict(polygons.within(whole, frame).dtypes) == {"no": "bigint", "x": "int", "y": "decimal(9,2)", "polygon": "bigint"}
