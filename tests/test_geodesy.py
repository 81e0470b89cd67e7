"""Areas and lengths on the ellipsoid: against an integral, the whole globe, and a projected grid against its area scale."""

import math

import pytest
from pyspark.sql import functions as F

from talweg.functions import geodesy
from talweg.functions import projections as P
from talweg.sources.grid import Grid, TerrainError


def strip(s, lat0, lat1, lon):
    """Area of a box of angles by Simpson's rule."""
    n, total, h = 2000, 0.0, math.radians(lat1 - lat0) / 2000
    for k in range(n):
        for t, w in ((0, 1), (0.5, 4), (1, 1)):
            phi = math.radians(lat0) + (k + t) * h
            total += w * h / 6 * s.ellipsoid[0] ** 2 * (1 - s.e2) * math.cos(phi) / (1 - s.e2 * math.sin(phi) ** 2) ** 2
    return total * math.radians(lon)


def test_geographic_cells(spark):
    s, g = P.system("EPSG:4283"), Grid(180, 360, -180.0, 1.0, 0.0, 90.0, 0.0, -1.0, crs="EPSG:4283")
    cells = spark.range(180 * 360).select(F.lit(1).cast("long").alias("group_id"), F.col("id").alias("cell_id"))
    total = geodesy.areas(cells, g).first().area_m2
    assert total == pytest.approx(5.100656217e14, rel=1e-9)  # of the ellipsoid of GRS 1980
    one = geodesy.areas(cells.where("cell_id = 45005").withColumn("group_id", F.lit(2).cast("long")), g).first()
    assert one.area_m2 == pytest.approx(strip(s, -36, -35, 1.0), rel=1e-9) and one.area_ha == one.area_m2 / 1e4


@pytest.mark.parametrize("crs, x, y", [("EPSG:28355", 300_000.0, 5_800_000.0), ("EPSG:3577", 1_000_000.0, -4_000_000.0), ("EPSG:3857", 16_000_000.0, -4_500_000.0)])
def test_projected_cells_and_steps(spark, crs, x, y):
    """Against the projection's own scale, found by differences."""
    g, s = Grid(4, 4, x, 25.0, 0.0, y, 0.0, -25.0, crs=crs), P.system(crs)
    row = spark.createDataFrame([(5, 6, 9, 10)], "cell_id long, e long, s long, d long").select(
        geodesy.cell_area(g, F.col("cell_id")).alias("area"), *(geodesy.step_length(g, F.col("cell_id"), F.col(k)).alias(k) for k in "esd")
    ).first()
    cx, cy = x + 37.5, y - 37.5
    if crs != "EPSG:3857":
        assert row.area == pytest.approx(625.0, rel=2e-3)
    if crs == "EPSG:3577":
        assert row.area == pytest.approx(625.0, rel=1e-6)
    lon, lat = s.inverse(cx, cy)
    w = 1 - s.e2 * math.sin(math.radians(lat)) ** 2
    m, n = s.ellipsoid[0] * (1 - s.e2) / w**1.5, s.ellipsoid[0] / math.sqrt(w) * math.cos(math.radians(lat))

    def ground(dx, dy):
        (a, b), (c, d) = s.inverse(cx - dx / 2, cy - dy / 2), s.inverse(cx + dx / 2, cy + dy / 2)
        return math.radians(c - a) * n, math.radians(d - b) * m

    (ex, ey), (sx, sy) = ground(25.0, 0.0), ground(0.0, -25.0)
    assert row.area == pytest.approx(abs(ex * sy - ey * sx), rel=1e-6)
    assert row.e == pytest.approx(math.hypot(ex, ey), rel=1e-5) and row.s == pytest.approx(math.hypot(sx, sy), rel=1e-5)
    assert row.d == pytest.approx(math.hypot(ex + sx, ey + sy), rel=1e-5)


def test_a_grid_without_a_system_raises():
    with pytest.raises(TerrainError, match="reference system"):
        geodesy._system(Grid(2, 2))
