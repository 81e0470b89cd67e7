"""Areas and lengths on the ellipsoid, for projected and geographic grids, as column expressions.

A cell's corners are taken to longitude and latitude and laid out in strips of equal area
(authalic latitude), where its area is that of a polygon: exact for cells of geographic
grids, and for projected ones but for the bend of their sides, some 1e-9 of cells of a
kilometre. A step between neighbouring cells is short, so its length follows from the radii
of curvature at its middle, with an error of about the square of its share of the globe.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions import geometry as G
from talweg.functions import projections
from talweg.sources.grid import Grid, TerrainError


def eccentricity_squared(ellipsoid: tuple[float, float]) -> float:
    return (2 - 1 / ellipsoid[1]) / ellipsoid[1]


def _system(grid: Grid) -> projections.System:
    if not grid.crs:
        raise TerrainError("areas on the ellipsoid need a grid with a reference system")
    return projections.system(grid.crs)


def authalic_height(system: projections.System, lat: Column) -> Column:
    """Area between the equator and a latitude (degrees) on the ellipsoid, for a turn of one radian."""
    e2 = system.e2
    e, s = math.sqrt(e2), F.sin(F.radians(lat))
    return (s / (1 - e2 * s * s) + F.atanh(s * e) / e) * ((1 - e2) / 2 * system.ellipsoid[0] ** 2)


def cell_area(grid: Grid, cell: Column) -> Column:
    """Square metres of a cell on the ellipsoid."""
    system = _system(grid)
    low_x, low_y, high_x, high_y = G.cell_box(grid, cell)
    flat = []
    for x, y in ((low_x, low_y), (high_x, low_y), (high_x, high_y), (low_x, high_y)):
        lon, lat = system.inverse(x, y)
        flat.append((F.radians(lon), authalic_height(system, lat)))
    middle = flat[0]  # sums of differences keep their digits
    moved = [(u - middle[0], v - middle[1]) for u, v in flat]
    return F.abs(sum((a[0] * b[1] - b[0] * a[1] for a, b in zip(moved[1:], moved[2:])), F.lit(0.0))) / 2


def areas(groups: DataFrame, grid: Grid) -> DataFrame:
    """(group_id, area_m2, area_ha) of groups of cells (group_id, cell_id) on the ellipsoid. Cells of one row of a geographic grid are alike, so they are counted first."""
    if type(_system(grid)) is projections.System:
        rows = groups.groupBy("group_id", G.row_of(grid, F.col("cell_id")).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
        total = rows.select("group_id", (F.col("_n") * cell_area(grid, F.col("_r") * grid.cols)).alias("_a"))
    else:
        total = groups.select("group_id", cell_area(grid, F.col("cell_id")).alias("_a"))
    return total.groupBy("group_id").agg(F.sum("_a").alias("area_m2")).withColumn("area_ha", F.col("area_m2") / 1e4)


def step_length(grid: Grid, cell: Column, down: Column) -> Column:
    """Metres on the ellipsoid between the centres of neighbouring cells."""
    system = _system(grid)
    (lon0, lat0), (lon1, lat1) = (system.inverse(G.centre_x(grid, c), G.centre_y(grid, c)) for c in (cell, down))
    s = F.sin(F.radians((lat0 + lat1) / 2))
    w = 1 - system.e2 * s * s
    north = F.radians(lat1 - lat0) * (system.ellipsoid[0] * (1 - system.e2)) / F.pow(w, F.lit(1.5))
    east = F.radians(lon1 - lon0) * system.ellipsoid[0] / F.sqrt(w) * F.cos(F.radians((lat0 + lat1) / 2))
    return F.hypot(north, east)


def with_length(paths: DataFrame, grid: Grid) -> DataFrame:
    """Flow paths with length_m on the ellipsoid."""
    return paths.withColumn("length_m", step_length(grid, F.col("cell_id"), F.col("down_id")))
