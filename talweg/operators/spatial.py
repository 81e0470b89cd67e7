"""Spatial joins of many outlet lines and many points with the flow segments.

A segment joins two neighbouring cells, so it lies in few buckets of a square grid over the
cells. Lines and points are dealt to buckets too, and only what shares a bucket is compared:
the joins are on bucket numbers, never of all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions import geometry as G
from talweg.functions.lineage import cut, drop_cut
from talweg.sources.grid import Grid

BUCKET = 32  # cells on a bucket's side, for lines
NEAR = 8  # the same for points, in the first round
MARGIN = 1e-6  # cells by which a line's buckets are widened


def _segments(paths: DataFrame, grid: Grid) -> DataFrame:
    """Flow segments with their ends on the map (ax .. by) and in cells (au .. bv)."""
    cell, down = F.col("cell_id"), F.col("down_id")
    ends = paths.select("cell_id", "acc_cells", *(G.row_of(grid, x).alias(f"{n}r") for n, x in (("a", cell), ("b", down))), *(G.col_of(grid, x).alias(f"{n}c") for n, x in (("a", cell), ("b", down))))
    x = lambda c: F.lit(float(grid.x0)) + (F.col(c) + 0.5) * F.lit(float(grid.dx))
    y = lambda r: F.lit(float(grid.y0)) + (F.col(r) + 0.5) * F.lit(float(grid.dy))
    return ends.select("cell_id", "acc_cells", "ar", "ac", "br", "bc", x("ac").alias("ax"), y("ar").alias("ay"), x("bc").alias("bx"), y("br").alias("by"))


def _buckets(low: Column, high: Column) -> Column:
    return F.sequence(low.cast("long"), high.cast("long"))


def line_pieces(lines: DataFrame) -> DataFrame:
    """(line_id, x0, y0, x1, y1) of lines (line_id, points: array of x, y); a point without a number ends a piece."""
    at = F.posexplode(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0)))).alias("_i", "_p")
    got = lines.where(F.size("points") > 1).select("line_id", "points", at)
    q = F.element_at("points", F.col("_i") + 2)
    values = [F.col("_p")["x"], F.col("_p")["y"], q["x"], q["y"]]
    pieces = got.select("line_id", *(v.cast("double").alias(n) for v, n in zip(values, ("x0", "y0", "x1", "y1"))))
    for n in ("x0", "y0", "x1", "y1"):
        pieces = pieces.where(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")))
    return pieces


def lines_crossing(paths: DataFrame, grid: Grid, lines: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(line_id, cell_id, acc_cells): the flow segments that each line meets, once each.

    A piece of a line goes to the buckets that it passes through, column by column, and to
    those within MARGIN of it. Lines without two points meet nothing; lines that share an
    id are one line; null is an id like others.
    """
    # in cells from the centre of the first one; a segment is inside the box of its ends
    seg = _segments(paths, grid)
    by_bucket = seg.withColumn("gx", F.explode(_buckets(F.floor(F.least("ac", "bc") / bucket), F.floor(F.greatest("ac", "bc") / bucket))))
    by_bucket = by_bucket.withColumn("gy", F.explode(_buckets(F.floor(F.least("ar", "br") / bucket), F.floor(F.greatest("ar", "br") / bucket))))
    u = lambda c: (F.col(c) - grid.x0) / F.lit(float(grid.dx)) - 0.5
    v = lambda c: (F.col(c) - grid.y0) / F.lit(float(grid.dy)) - 0.5
    p = line_pieces(lines).select("*", u("x0").alias("u0"), v("y0").alias("v0"), u("x1").alias("u1"), v("y1").alias("v1"))
    lo_u, hi_u = F.least("u0", "u1") - MARGIN, F.greatest("u0", "u1") + MARGIN
    first, last = F.greatest(F.floor(lo_u / bucket), F.lit(0)), F.least(F.floor(hi_u / bucket), F.lit((grid.cols - 1) // bucket))
    p = p.where(first <= last).withColumn("gx", F.explode(_buckets(first, last)))
    du = F.col("u1") - F.col("u0")
    t = lambda edge: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - F.col("u0")) / du))
    left, right = F.col("gx") * bucket - MARGIN, (F.col("gx") + 1) * bucket + MARGIN
    at = lambda s: F.col("v0") + s * (F.col("v1") - F.col("v0"))
    flat = F.abs(du) < MARGIN  # upright pieces pass through all their rows
    a, b = F.when(flat, F.col("v0")).otherwise(at(t(left))), F.when(flat, F.col("v1")).otherwise(at(t(right)))
    low, high = F.greatest(F.floor((F.least(a, b) - MARGIN) / bucket), F.lit(0)), F.least(F.floor((F.greatest(a, b) + MARGIN) / bucket), F.lit((grid.rows - 1) // bucket))
    p = p.where(low <= high).withColumn("gy", F.explode(_buckets(low, high))).select("line_id", "x0", "y0", "x1", "y1", "gx", "gy")
    c = F.col
    meets = G.segments_meet((c("ax"), c("ay")), (c("bx"), c("by")), (c("x0"), c("y0")), (c("x1"), c("y1")))
    return by_bucket.join(p, ["gx", "gy"]).where(meets).select("line_id", "cell_id", "acc_cells").distinct()


def outlets_of_lines(crossed: DataFrame) -> DataFrame:
    """(line_id, n_crossed, cell_id, acc_cells): how many segments each line meets, and the model outlet among them, by accumulation and then id."""
    top = F.max(F.struct("acc_cells", "cell_id")).alias("m")
    return crossed.groupBy("line_id").agg(F.count(F.lit(1)).alias("n_crossed"), top).select("line_id", "n_crossed", "m.cell_id", "m.acc_cells")


def nearest_segments(paths: DataFrame, grid: Grid, points: DataFrame, k: int = 1, max_distance: float | None = None, bucket: int = NEAR) -> DataFrame:
    """(point_id, rank, cell_id, distance): the k flow segments nearest to each point, ties by the smaller id.

    Each round compares a point with the segments that begin in its bucket and the eight
    around it. Others are farther than a bucket's side less one cell; if the k-th distance
    is below that bound, or the bound is beyond max_distance, the point is done. Points that are not go
    on with buckets of twice the side: as many rounds as doublings from the first side to
    the grid's. Points without finite coordinates find nothing; equal points are compared once.
    """
    c = F.col
    reach = min(grid.cell_width, grid.cell_height)
    seg = cut(_segments(paths, grid).select("cell_id", "ar", "ac", "ax", "ay", "bx", "by"))
    placed = points.select("point_id", c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))
    for n in ("x", "y"):
        placed = placed.where(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")))
    placed = placed.select("point_id", (c("x") + 0.0).alias("x"), (c("y") + 0.0).alias("y"))
    pending = cut(placed.select("x", "y").distinct())
    found, side, last = [], bucket, 2 * max(grid.rows, grid.cols)
    best = Window.partitionBy("x", "y").orderBy("distance", "cell_id")
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    while not pending.isEmpty():
        end = side > last  # the first nine buckets hold the grid, wherever the point is
        mine = lambda v, n, side=side: F.least(F.greatest(F.floor(v / side), F.lit(-1)), F.lit((n - 1) // side + 1))
        gx, gy = mine((c("x") - grid.x0) / F.lit(float(grid.dx)), grid.cols), mine((c("y") - grid.y0) / F.lit(float(grid.dy)), grid.rows)
        near = pending.select("x", "y", gx.alias("gx"), gy.alias("gy"), F.explode(around).alias("s")).select("x", "y", (c("gx") + c("s.i")).alias("gx"), (c("gy") + c("s.j")).alias("gy"))
        dealt = seg.withColumn("gx", F.floor(c("ac") / side)).withColumn("gy", F.floor(c("ar") / side))
        d = G.point_segment_distance(c("x"), c("y"), c("ax"), c("ay"), c("bx"), c("by"))
        met = near.join(dealt, ["gx", "gy"]).select("x", "y", "cell_id", d.alias("distance"))
        top = cut(met.withColumn("rank", F.row_number().over(best)).where(c("rank") <= k))
        bound = (side - 1) * reach
        if end:
            found.append(top)
            drop_cut(pending)
            break
        state = pending.join(top.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_far")), ["x", "y"], "left")
        done = F.coalesce((c("_n") >= k) & (c("_far") < bound), F.lit(False)) | F.lit(max_distance is not None and max_distance < bound)
        state = cut(state.select("x", "y", done.alias("_done")))
        found.append(top.join(state.where("_done"), ["x", "y"], "left_semi"))
        drop_cut(pending)
        pending = state.where("not _done").select("x", "y")
        side *= 2
    every = pending.selectExpr("x", "y", "1L cell_id", "1D distance", "1 rank").where("false")
    for part in found:
        every = every.unionByName(part)
    if max_distance is not None:
        every = every.where(c("distance") <= float(max_distance))
    return placed.join(every, ["x", "y"]).select("point_id", "rank", "cell_id", "distance")
