"""Analysis masks and input checks.

A mask is a drawing, as a list of rings, or a layer of any size, as a table (polygon_id,
points) with a row for each ring. A polygon covers what its rings enclose an odd number of
times, so holes are left out and a ring that crosses itself keeps both its halves; a mask
covers what any of its polygons does.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions import geometry as G
from talweg.functions import projections
from talweg.operators.dissolve import dissolve
from talweg.sources.grid import Grid, TerrainError, is_valid

Ring = list[tuple[float, float]]
Mask = list[Ring] | DataFrame


def closed(ring: Ring) -> Ring:
    """The ring with its first point repeated at the end; three different points at least."""
    ring = [(float(x), float(y)) for x, y in ring]
    if len(set(ring)) < 3:
        raise TerrainError("a mask polygon needs three vertices")
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def wkb_rings(wkb: bytes) -> list[tuple[int, Ring]]:
    """(number of the polygon, ring) of a Polygon or MultiPolygon in two or more dimensions; others have none."""

    def read(at: int) -> tuple[int, list]:
        order = "<" if wkb[at] == 1 else ">"
        code = struct.unpack_from(order + "I", wkb, at + 1)[0]
        at += 5 + (4 if code & 0x20000000 else 0)  # a reference system may be named
        more, kind = divmod(code & 0x0FFFFFFF, 1000)
        dims = 2 + bool(code & 0x80000000 or more in (1, 3)) + bool(code & 0x40000000 or more in (2, 3))
        n, at = struct.unpack_from(order + "I", wkb, at)[0], at + 4
        found: list = []
        if kind == 3:
            for _ in range(n):
                k, at = struct.unpack_from(order + "I", wkb, at)[0], at + 4
                flat = struct.unpack_from(order + "d" * (dims * k), wkb, at)
                found.append(list(zip(flat[::dims], flat[1::dims])))
                at += 8 * dims * k
            return at, [found]
        if kind == 6:
            for _ in range(n):
                at, part = read(at)
                found += part
            return at, found
        return len(wkb), []

    return [(k, ring) for k, rings in enumerate(read(0)[1]) for ring in rings]


def mask_layer(layer: DataFrame, geometry: str = "geom") -> DataFrame:
    """(polygon_id, points) of a layer's polygons, from a WKB column: a mask. Equal geometries count once; rows without polygons give none."""
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def rings(batches):
        for b in batches:
            out = [(f"{i}/{k}", [{"x": x, "y": y} for x, y in ring]) for i, wkb in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, ring in wkb_rings(wkb) if len(set(ring)) > 2]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], kind)], ["polygon_id", "points"])

    found = layer.select(F.sha2(F.col(geometry), 256).alias("id"), F.col(geometry).alias("wkb")).where("wkb is not null").dropDuplicates(["id"])
    return found.mapInArrow(rings, "polygon_id string, points array<struct<x:double,y:double>>")


def as_layer(cells: DataFrame, mask: Mask) -> DataFrame:
    if isinstance(mask, DataFrame):
        return mask.select(F.col("polygon_id").cast("string").alias("polygon_id"), "points")
    rows = [(str(k), closed(ring)) for k, ring in enumerate(mask)]
    return cells.sparkSession.createDataFrame(rows, "polygon_id string, points array<struct<x:double,y:double>>")


def mask_in_grid(grid: Grid, mask: Mask, crs: str = "", assume_same_datum: bool = False) -> Mask:
    """The mask with its points converted into the grid's reference system; a mask or a grid without one is taken as it is.

    Vertices are converted, edges stay straight between them. Raises for systems that are not known here and for other datums.
    """
    if not crs or not grid.crs or crs.strip().upper() == grid.crs.strip().upper():
        return mask
    if isinstance(mask, DataFrame):
        return projections.reproject_points(mask, crs, grid.crs, assume_same_datum=assume_same_datum)
    change = projections.transform(crs, grid.crs, assume_same_datum)
    return [[change(float(x), float(y)) for x, y in ring] for ring in mask]


def _edges_by_row(cells: DataFrame, grid: Grid, mask: Mask) -> DataFrame:
    """(_row, _rings): for each grid row, the edges of each polygon that reach its band, dealt to rows in Spark."""
    points = F.col("points")
    last = F.element_at(points, -1)
    ring = F.when((F.element_at(points, 1)["x"] == last["x"]) & (F.element_at(points, 1)["y"] == last["y"]), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    layer = as_layer(cells, mask).where(F.size("points") > 2).select("polygon_id", ring.alias("p"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.element_at("p", i).alias("a"), F.element_at("p", i + 1).alias("b")))
    e = layer.select("polygon_id", F.explode(pairs).alias("e")).select("polygon_id", *(F.col(f"e.{q}.{k}").alias(f"{k}{i}") for i, q in enumerate("ab") for k in "xy"))
    at = lambda c: (F.col(c) - F.lit(float(grid.y0))) / F.lit(float(grid.dy))
    # a row more on both sides: an edge on the line between two rows touches both
    first, end = F.greatest(F.floor(F.least(at("y0"), at("y1"))) - 1, F.lit(0)), F.least(F.floor(F.greatest(at("y0"), at("y1"))) + 1, F.lit(grid.rows - 1))
    e = e.where(first <= end).select("polygon_id", F.explode(F.sequence(first, end)).alias("_row"), F.struct("x0", "y0", "x1", "y1").alias("e"))
    return e.groupBy("_row", "polygon_id").agg(F.collect_list("e").alias("edges")).groupBy("_row").agg(F.collect_list("edges").alias("_rings"))


def _inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd test: edges that cross the ray to the right of the point."""

    def crosses(e: Column) -> Column:
        at = e["x0"] + (y - e["y0"]) * ((e["x1"] - e["x0"]) / (e["y1"] - e["y0"]))
        return ((e["y0"] > y) != (e["y1"] > y)) & (x < at)

    return F.pmod(F.size(F.filter(edges, crosses)), F.lit(2)) == 1


def _touches(box: tuple[Column, Column, Column, Column], edges: Column) -> Column:
    """Whether an edge meets the box: their boxes meet, and the box's corners are not all on one side of the edge."""
    a, b, c, d = box

    def meets(e: Column) -> Column:
        near = (a <= F.greatest(e["x0"], e["x1"])) & (c >= F.least(e["x0"], e["x1"])) & (b <= F.greatest(e["y0"], e["y1"])) & (d >= F.least(e["y0"], e["y1"]))
        side = [G.orientation(e["x0"], e["y0"], e["x1"], e["y1"], px, py) for px, py in ((a, b), (c, b), (a, d), (c, d))]
        return near & ~((F.least(*side) > 0) | (F.greatest(*side) < 0))

    return F.exists(edges, meets)


def no_mask(mask: Mask | None) -> bool:
    return mask is None or (not isinstance(mask, DataFrame) and not mask)


def in_mask(cells: DataFrame, grid: Grid, rings: Mask) -> DataFrame:
    """The cells that any of the polygons touches. A cell is tested against the edges that reach its row, not against the whole drawing."""
    cell = F.col("cell_id")
    box, x, y = G.cell_box(grid, cell), G.centre_x(grid, cell), G.centre_y(grid, cell)
    met = cells.withColumn("_row", G.row_of(grid, cell)).join(_edges_by_row(cells, grid, rings), "_row")
    return met.where(F.exists("_rings", lambda edges: _inside(x, y, edges) | _touches(box, edges))).select(*cells.columns)


def extent_misses(grid: Grid, rings: Mask) -> bool:
    """Whether the polygons' box lies outside the grid's."""
    if isinstance(rings, DataFrame):
        p = rings.select(F.explode("points").alias("p"))
        xs0, xs1, ys0, ys1 = p.agg(F.min("p.x"), F.max("p.x"), F.min("p.y"), F.max("p.y")).first()
        if xs0 is None:
            raise TerrainError("the mask holds no polygon")
    else:
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        xs0, xs1, ys0, ys1 = min(xs), max(xs), min(ys), max(ys)
    gx, gy = sorted((grid.x0, grid.x0 + grid.cols * grid.dx)), sorted((grid.y0, grid.y0 + grid.rows * grid.dy))
    return xs1 < gx[0] or xs0 > gx[1] or ys1 < gy[0] or ys0 > gy[1]


def mask_cells(cells: DataFrame, grid: Grid, rings: Mask) -> DataFrame:
    """cells (a row for every cell of the grid) that the mask touches, with ``valid``."""
    return in_mask(cells, grid, rings).withColumn("valid", is_valid(F.col("z"), grid.nodata))


def mask_filter(cells: DataFrame, grid: Grid, rings: Mask) -> DataFrame:
    """(cell_id, z) of valid cells in the mask. Routing must come after: the mask decides what is boundary."""
    return mask_cells(cells, grid, rings).where("valid").select("cell_id", F.col("z").cast("double").alias("z"))


def mask_quality(cells: DataFrame, grid: Grid, rings: Mask | None) -> DataFrame:
    """One row: has_mask, mask_cells, valid_cells, nodata_cells."""
    if no_mask(rings):
        zero = F.lit(0).cast("long")
        return cells.sparkSession.range(1).select(F.lit(False).alias("has_mask"), zero.alias("mask_cells"), zero.alias("valid_cells"), zero.alias("nodata_cells"))
    return mask_cells(cells, grid, rings).agg(F.lit(True).alias("has_mask"), F.count(F.lit(1)).alias("mask_cells"), F.count_if("valid").alias("valid_cells"), F.count_if(~F.col("valid")).alias("nodata_cells"))


def nodata_cells(cells: DataFrame, grid: Grid, rings: Mask | None = None) -> DataFrame:
    """(cell_id) of invalid cells, in the mask if there is one."""
    inside = cells if no_mask(rings) else in_mask(cells, grid, rings)
    return inside.where(~is_valid(F.col("z"), grid.nodata)).select("cell_id")


LARGE_LAYER = 750_000


def nodata_areas(cells: DataFrame, grid: Grid, rings: Mask | None = None) -> DataFrame:
    """(group_id, wkb, area, warning): the outline of the cells without data, in the mask if there is one, as one MultiPolygon; no row without such cells."""
    bad = nodata_cells(cells, grid, rings).select(F.lit(0).cast("long").alias("group_id"), F.col("cell_id").cast("long").alias("cell_id"))
    return dissolve(bad, grid).withColumn("warning", F.lit("cells without data" if no_mask(rings) else "cells without data in the mask"))


def validate(cells: DataFrame, grid: Grid, rings: Mask | None = None, min_acc: int = 10_000, crs_is_projected: bool | None = None, mask_crs: str = "") -> list[tuple[str, str]]:
    """(code, message) of everything a user should know before a run; errors raise. The grid's own reference system tells whether it is projected, unless the caller does."""
    out = []
    if not no_mask(rings):
        rings = mask_in_grid(grid, rings, mask_crs)
    projected = grid.projected if crs_is_projected is None else crs_is_projected
    if projected is False:
        out.append(("geographic_crs", f"the grid is not in a projected reference system ({grid.crs or 'not named'}): lengths and areas are in its own units"))
    elif projected is None and grid.crs:
        out.append(("unknown_crs", f"whether {grid.crs} is a projected reference system is not known here: lengths and areas are in its units"))
    if not no_mask(rings) and extent_misses(grid, rings):
        raise TerrainError("the mask lies outside the grid")
    q = mask_quality(cells, grid, rings).first()
    if not no_mask(rings):
        if not q.valid_cells:
            raise TerrainError("the mask holds no valid cell")
        if q.nodata_cells:
            out.append(("mask_nodata", f"the mask holds {q.nodata_cells} cells without data"))
        valid = q.valid_cells
    else:
        got = cells.agg(F.count_if(is_valid(F.col("z"), grid.nodata)).alias("v"), F.count(F.lit(1)).alias("n")).first()
        valid = got.v
        if not valid:
            raise TerrainError("the grid has no valid cell")
        if got.v < grid.rows * grid.cols:
            out.append(("nodata", f"the grid has {grid.rows * grid.cols - got.v} cells without data, whose neighbours become outlets"))
    if valid > LARGE_LAYER and min_acc <= 1:
        out.append(("large_layer", f"{valid} flow paths would be shown: raise the least accumulation"))
    return out
