"""Projections: published coordinates, an integral, conformal and equal-area properties, and round trips."""

import math
import random

import pytest

from talweg.functions import projections as P
from talweg.sources.grid import TerrainError


def dms(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


@pytest.mark.parametrize("lat, lon, east, north", [(dms(-37, 57, 3.7203), dms(144, 25, 29.5244), 273741.297, 5796489.777), (dms(-37, 39, 10.1561), dms(143, 55, 35.3839), 228854.052, 5828259.038)])
def test_published_coordinates(lat, lon, east, north):
    """Two trig points in zone 55 of the Map Grid of Australia 1994, from its technical manual."""
    x, y = P.system("EPSG:28355").forward(lon, lat)
    assert abs(x - east) < 1e-3 and abs(y - north) < 1e-3


def test_meridian_arc_is_the_integral():
    s = P.TransverseMercator("", P.GRS80, scale=1.0, east=0.0)
    n, total = 20_000, 0.0
    for k in range(n):  # Simpson's rule to 60 degrees
        h = math.radians(60) / n
        for t, w in ((k * h, 1), ((k + 0.5) * h, 4), ((k + 1) * h, 1)):
            total += w * h / 6 * s.ellipsoid[0] * (1 - s.e2) / (1 - s.e2 * math.sin(t) ** 2) ** 1.5
    assert abs(s.forward(0.0, 60.0)[1] - total) < 1e-5


SYSTEMS = ["EPSG:32633", "EPSG:32755", "EPSG:28355", "EPSG:7850", "EPSG:25832", "EPSG:26912", "EPSG:3857", "EPSG:2154", "EPSG:3034", "EPSG:3112", "EPSG:3577", "EPSG:5070"]


def places(crs, n=200):
    """Longitudes and latitudes where the system is used."""
    s, rnd = P.system(crs), random.Random(crs)
    mid = getattr(s, "lon0", 10.0)
    south = getattr(s, "north", 0.0) == 10_000_000.0 or getattr(s, "lat1", 0.0) < 0
    wide = 4.0 if isinstance(s, P.TransverseMercator) else 20.0
    return [(mid + rnd.uniform(-wide, wide), rnd.uniform(-60, -5) if south else rnd.uniform(5, 70)) for _ in range(n)]


@pytest.mark.parametrize("crs", SYSTEMS)
def test_round_trips_below_a_millimetre(crs):
    s = P.system(crs)
    for lon, lat in places(crs):
        x, y = s.forward(lon, lat)
        a, b = s.inverse(x, y)
        assert abs(a - lon) * 111_320 < 1e-4 and abs(b - lat) * 111_320 < 1e-4


@pytest.mark.parametrize("crs", SYSTEMS)
def test_shapes_or_areas_are_kept(crs):
    s = P.system(crs)
    sphere = isinstance(s, P.WebMercator)
    for lon, lat in places(crs, 30):
        h = 1e-5
        p = lambda dx, dy: s.forward(lon + dx, lat + dy)
        ex, ey = ((p(h, 0)[k] - p(-h, 0)[k]) / (2 * math.radians(h)) for k in (0, 1))
        nx, ny = ((p(0, h)[k] - p(0, -h)[k]) / (2 * math.radians(h)) for k in (0, 1))
        phi, e2 = math.radians(lat), 0.0 if sphere else s.e2
        w = math.sqrt(1 - e2 * math.sin(phi) ** 2)
        parallel, meridian = s.ellipsoid[0] * math.cos(phi) / w, s.ellipsoid[0] * (1 - e2) / w**3
        if isinstance(s, P.AlbersConic):
            assert (ex * ny - ey * nx) / (parallel * meridian) == pytest.approx(1, abs=1e-6)
        else:
            assert ex / parallel == pytest.approx(ny / meridian, abs=1e-6) and ey / parallel == pytest.approx(-nx / meridian, abs=1e-6)
            scale = math.hypot(ex, ey) / parallel
            if isinstance(s, P.TransverseMercator) and abs(lon - s.lon0) < 0.1:
                assert scale == pytest.approx(0.9996, abs=1e-5)
    if isinstance(s, P.LambertConic):
        for lat in (s.lat1, s.lat2):  # true along both parallels
            x0, y0 = s.forward(s.lon0 - 1e-5, lat)
            x1, y1 = s.forward(s.lon0 + 1e-5, lat)
            w = math.sqrt(1 - s.e2 * math.sin(math.radians(lat)) ** 2)
            assert math.hypot(x1 - x0, y1 - y0) / math.radians(2e-5) == pytest.approx(s.ellipsoid[0] * math.cos(math.radians(lat)) / w, rel=1e-7)
        assert s.forward(s.lon0, s.lat0) == pytest.approx((s.east, s.north), abs=1e-6)


@pytest.mark.parametrize("source, target", [("EPSG:28355", "EPSG:28354"), ("EPSG:4283", "EPSG:3577"), ("EPSG:3112", "EPSG:28355"), ("EPSG:32633", "EPSG:3857"), ("EPSG:2154", "EPSG:25831"), ("EPSG:4326", "EPSG:4326")])
def test_columns_give_what_numbers_give(spark, source, target):
    at = [P.system(source).forward(lon, lat) for lon, lat in places(source, 40)]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(at)] + [(99, None, 1.0)], "k long, x double, y double")
    got = {r.k: (r.x, r.y) for r in P.reproject(df, source, target).collect()}
    change = P.transform(source, target)
    assert all(got[k] == pytest.approx(change(*p), rel=1e-12, abs=1e-6) for k, p in enumerate(at)) and (source == target or got[99][0] is None)
    lines = spark.createDataFrame([(1, at)], "k long, points array<struct<x:double,y:double>>")
    line = P.reproject_points(lines, source, target).first().points
    assert [tuple(p) for p in line] == [pytest.approx(change(*p), rel=1e-12, abs=1e-6) for p in at]


def test_what_is_not_converted():
    with pytest.raises(TerrainError, match="not known"):
        P.system("EPSG:31466")
    with pytest.raises(TerrainError, match="datums"):
        P.transform("EPSG:28355", "EPSG:7855")
    x, y = P.transform("EPSG:28355", "EPSG:7855", assume_same_datum=True)(300_000.0, 5_800_000.0)
    assert abs(x - 300_000) < 1e-3 and abs(y - 5_800_000) < 1e-3
