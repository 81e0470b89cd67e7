"""Planar geometry and units as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talweg.sources.grid import Grid


def row_of(grid: Grid, cell: Column) -> Column:
    return F.floor(cell / grid.cols).cast("long")


def col_of(grid: Grid, cell: Column) -> Column:
    return F.pmod(cell, F.lit(grid.cols)).cast("long")


def centre_x(grid: Grid, cell: Column) -> Column:
    return F.lit(float(grid.x0)) + (col_of(grid, cell) + 0.5) * F.lit(float(grid.dx))


def centre_y(grid: Grid, cell: Column) -> Column:
    return F.lit(float(grid.y0)) + (row_of(grid, cell) + 0.5) * F.lit(float(grid.dy))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def centre(grid: Grid, cell: Column) -> Column:
    return point(centre_x(grid, cell), centre_y(grid, cell))


def cell_box(grid: Grid, cell: Column) -> tuple[Column, Column, Column, Column]:
    """xmin, ymin, xmax, ymax of a cell."""
    r, c = row_of(grid, cell), col_of(grid, cell)
    x0, x1 = F.lit(float(grid.x0)) + c * F.lit(float(grid.dx)), F.lit(float(grid.x0)) + (c + 1) * F.lit(float(grid.dx))
    y0, y1 = F.lit(float(grid.y0)) + r * F.lit(float(grid.dy)), F.lit(float(grid.y0)) + (r + 1) * F.lit(float(grid.dy))
    return F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)


def cell_ring(grid: Grid, cell: Column) -> Column:
    """Closed ring of a cell, from its lower left corner anticlockwise."""
    a, b, c, d = cell_box(grid, cell)
    return F.array(point(a, b), point(c, b), point(c, d), point(a, d), point(a, b))


def cell_at(grid: Grid, x: Column, y: Column) -> Column:
    """Cell that holds a point; null outside the grid. Whether the cell is valid is for a join to say."""
    c = F.floor((x - grid.x0) / F.lit(float(grid.dx)))
    r = F.floor((y - grid.y0) / F.lit(float(grid.dy)))
    inside = (r >= 0) & (r < grid.rows) & (c >= 0) & (c < grid.cols)
    return F.when(inside, r * grid.cols + c).cast("long")


def segment_length(grid: Grid, cell: Column, down: Column) -> Column:
    return F.hypot(centre_x(grid, down) - centre_x(grid, cell), centre_y(grid, down) - centre_y(grid, cell))


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of the triangle a, b, c."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_meet(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether the closed segments ab and cd have a point in common; each point is (x, y)."""
    d1, d2 = orientation(*c, *d, *a), orientation(*c, *d, *b)
    d3, d4 = orientation(*a, *b, *c), orientation(*a, *b, *d)
    boxes = (F.greatest(a[0], b[0]) >= F.least(c[0], d[0])) & (F.greatest(c[0], d[0]) >= F.least(a[0], b[0])) & (F.greatest(a[1], b[1]) >= F.least(c[1], d[1])) & (F.greatest(c[1], d[1]) >= F.least(a[1], b[1]))
    apart = ((d1 > 0) & (d2 > 0)) | ((d1 < 0) & (d2 < 0)) | ((d3 > 0) & (d4 > 0)) | ((d3 < 0) & (d4 < 0))
    return boxes & ~apart


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(F.lit(0.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def impervious_fraction(value: Column, default: float = 0.0) -> Column:
    """Share from a share or a percentage: null gives the default; NaN and negatives 0; above 1 and up to 100 a percentage; above that 1."""
    v = value.cast("double")
    return F.when(v.isNull(), F.lit(float(default))).when(F.isnan(v) | (v < 0), F.lit(0.0)).when((v > 1) & (v <= 100), v / 100.0).when(v > 1, F.lit(1.0)).otherwise(v)


def hectares(area_m2: Column) -> Column:
    return area_m2 / 1e4


def square_km(area_m2: Column) -> Column:
    return area_m2 / 1e6


def kilometres(length_m: Column) -> Column:
    return length_m / 1e3


def epsg_code(authid: Column) -> Column:
    """Digits of ``EPSG:n``, or an empty string."""
    return F.regexp_extract(authid, r"(?i)^EPSG:(\d+)$", 1)
