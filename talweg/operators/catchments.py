"""Outlet lines, upstream areas and subcatchments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions import geometry as G
from talweg.functions.lineage import cut
from talweg.operators.trees import OpenCells, first_stop, fold, last_stop
from talweg.sources.grid import Grid, TerrainError

Point = tuple[float, float]


def line_crossing(paths: DataFrame, grid: Grid, line: list[Point]) -> DataFrame:
    """(cell_id, acc_cells) of flow segments that meet the line. The line's pieces are one array, so the plan does not grow with them, and the box test comes first."""
    if len(line) < 2:
        raise TerrainError("an outlet line needs two points")
    cell, down = F.col("cell_id"), F.col("down_id")
    a, b = (G.centre_x(grid, cell), G.centre_y(grid, cell)), (G.centre_x(grid, down), G.centre_y(grid, down))
    pieces = [tuple(map(float, (*p, *q))) for p, q in zip(line, line[1:])]
    drawn = paths.sparkSession.createDataFrame([(pieces,)], "_line array<struct<x0:double,y0:double,x1:double,y1:double>>")
    xs, ys = [p[0] for p in line], [p[1] for p in line]
    near = (F.greatest(a[0], b[0]) >= min(xs)) & (F.least(a[0], b[0]) <= max(xs)) & (F.greatest(a[1], b[1]) >= min(ys)) & (F.least(a[1], b[1]) <= max(ys))
    meets = F.exists("_line", lambda s: G.segments_meet(a, b, (s["x0"], s["y0"]), (s["x1"], s["y1"])))
    return paths.where(near).crossJoin(F.broadcast(drawn)).where(meets).select("cell_id", "acc_cells").dropDuplicates(["cell_id"])  # drawn: one row


def crossing_order(crossed: DataFrame) -> DataFrame:
    """Largest accumulation first; ties by the larger id."""
    return crossed.orderBy(F.desc("acc_cells"), F.desc("cell_id"))


def model_outlet(crossed: DataFrame) -> DataFrame:
    """(cell_id, acc_cells) of the crossed cell of most accumulation; ties by the larger id."""
    return crossed.agg(F.max(F.struct("acc_cells", "cell_id")).alias("m")).where("m is not null").select("m.cell_id", "m.acc_cells")


def line_middle(line: list[Point]) -> Point:
    """The point half way along a drawn line: where an outlet node stands without a model outlet."""
    steps = [((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5 for (x0, y0), (x1, y1) in zip(line, line[1:])]
    left = sum(steps) / 2
    for (x0, y0), (x1, y1), step in zip(line, line[1:], steps):
        if step > 0 and left <= step:
            return x0 + (x1 - x0) * left / step, y0 + (y1 - y0) * left / step
        left -= step
    return line[0]


def nearest_segment(paths: DataFrame, grid: Grid, x: float, y: float, max_distance: float | None = None) -> DataFrame:
    """(cell_id, distance) of the flow segment nearest to a point; ties by the smaller id."""
    cell, down = F.col("cell_id"), F.col("down_id")
    d = G.point_segment_distance(F.lit(float(x)), F.lit(float(y)), G.centre_x(grid, cell), G.centre_y(grid, cell), G.centre_x(grid, down), G.centre_y(grid, down))
    best = paths.select("cell_id", d.alias("distance")).agg(F.min(F.struct("distance", "cell_id")).alias("m")).where("m is not null").select("m.cell_id", "m.distance")
    return best if max_distance is None else best.where(F.col("distance") <= float(max_distance))


def cell_under(cells: DataFrame, grid: Grid, x: float, y: float) -> DataFrame:
    """(cell_id) of the valid cell that holds a point; empty outside."""
    at = cells.sparkSession.range(1).select(G.cell_at(grid, F.lit(float(x)), F.lit(float(y))).alias("cell_id"))
    return cells.select("cell_id").join(F.broadcast(at), "cell_id", "left_semi")  # one cell


def _outlets(spark: SparkSession, outlets: list[int] | DataFrame) -> DataFrame:
    if isinstance(outlets, DataFrame):
        return outlets.select(F.col("cell_id").cast("long").alias("cell_id")).distinct()
    return spark.createDataFrame([(int(x),) for x in sorted(set(outlets))], "cell_id long")


def nearest_outlet(tree: DataFrame, grid: Grid, outlets: list[int] | DataFrame) -> DataFrame:
    """(cell_id, outlet): the first of the outlets on each cell's way, itself included; cells that pass none are left out."""
    marks = _outlets(tree.sparkSession, outlets).withColumn("_stop", F.lit(True))
    links = tree.select("cell_id", "down_id").join(marks, "cell_id", "left").select("cell_id", "down_id", F.coalesce("_stop", F.lit(False)).alias("stop"))
    return first_stop(links, grid).where("stop is not null").select("cell_id", F.col("stop").alias("outlet"))


def upstream(tree: DataFrame, grid: Grid, outlets: list[int] | DataFrame, limit: int | None = None) -> DataFrame:
    """(cell_id) of all cells that drain through one of the outlets, these included; with a limit, one more than it at most."""
    got = nearest_outlet(tree, grid, outlets).select("cell_id")
    return got if limit is None else got.limit(limit + 1)


def highlight(upstream_cells: DataFrame, paths: DataFrame) -> DataFrame:
    """(cell_id, acc_cells, strahler): the displayed cells among upstream_cells."""
    return paths.join(upstream_cells.select("cell_id"), "cell_id", "left_semi").select("cell_id", "acc_cells", "strahler")


def restrict_paths(paths: DataFrame, domain: DataFrame) -> DataFrame:
    """Flow paths of the domain's cells."""
    return paths.join(domain.select("cell_id").distinct(), "cell_id", "left_semi")


def greedy_outlets(tree: DataFrame, grid: Grid, min_cells: int, domain: DataFrame | None = None, residual: bool = True) -> DataFrame:
    """(cell_id, open_cells): outlets of subcatchments of at least min_cells.

    Going downstream, a cell gathers what the cells above it left open, plus itself; with
    min_cells or more it becomes an outlet and leaves nothing open. With ``residual`` a
    cell without a next cell in the domain becomes one whatever it has gathered.
    """
    m = max(1, int(min_cells))
    inside = tree.select("cell_id", "down_id", "acc")
    if domain is not None:
        inside = inside.join(domain.select("cell_id").distinct(), "cell_id", "left_semi")
    inside = cut(inside)
    below = inside.select(F.col("cell_id").alias("down_id"), F.lit(True).alias("_in"))
    linked = cut(inside.join(below, "down_id", "left").select("cell_id", F.when(F.col("_in"), F.col("down_id")).otherwise(-1).alias("down_id"), "acc"))
    opened = fold(linked, grid, lambda n: OpenCells(n, m))
    got = linked.join(opened, "cell_id")
    chosen = (F.col("value") >= m) | (F.lit(bool(residual)) & (F.col("down_id") < 0))
    return got.where(chosen).select("cell_id", F.col("value").alias("open_cells"))


def assign(tree: DataFrame, grid: Grid, outlets: DataFrame, domain: DataFrame | None = None) -> DataFrame:
    """(cell_id, outlet_id): each cell's first selected outlet downstream."""
    inside = tree.select("cell_id", "down_id") if domain is None else tree.select("cell_id", "down_id").join(domain.select("cell_id").distinct(), "cell_id", "left_semi")
    return nearest_outlet(inside, grid, outlets).select("cell_id", F.col("outlet").alias("outlet_id"))


def subcatchments(assigned: DataFrame, grid: Grid, cell_orders: DataFrame, stream_orders: DataFrame) -> DataFrame:
    """The subcatchment layer: outlet_id, cell_count, area_m2, area_ha, strahler (of the displayed outlet, else among all cells)."""
    size = assigned.groupBy("outlet_id").agg(F.count(F.lit(1)).alias("cell_count"))
    area = F.round(F.col("cell_count") * F.lit(grid.cell_area), 2)
    shown = stream_orders.select(F.col("cell_id").alias("outlet_id"), F.col("strahler").alias("_shown"))
    all_ = cell_orders.select(F.col("cell_id").alias("outlet_id"), F.col("strahler").alias("_all"))
    got = size.join(all_, "outlet_id", "left").join(shown, "outlet_id", "left")
    return got.select("outlet_id", "cell_count", area.alias("area_m2"), F.round(area / 1e4, 2).alias("area_ha"), F.coalesce("_shown", "_all").cast("int").alias("strahler"))


def totals(layer: DataFrame, grid: Grid, valid: int, min_cells: int) -> DataFrame:
    """One row: subcatchments, cells, total_ha to two and three places, and the most subcatchments that could be."""
    ha = F.sum("area_m2") / 1e4
    return layer.agg(F.count(F.lit(1)).alias("n"), F.sum("cell_count").alias("cells"), F.round(ha, 2).alias("total_ha_2"), F.round(ha, 3).alias("total_ha_3")).withColumn("most", F.lit(int(valid) // max(1, int(min_cells))).cast("long"))


def normalise_selection(tree: DataFrame, grid: Grid, outlets: list[int] | DataFrame) -> DataFrame:
    """(group_id, cell_id): upstream areas of the outlets, nested ones merged into the area that holds them.

    In a forest two areas are nested or disjoint, and an area that nests in no other has
    the last outlet on its cells' ways: one search gives each cell its group.
    """
    marks = _outlets(tree.sparkSession, outlets)
    return last_stop(tree, marks, grid).where("stop is not null").select(F.col("stop").alias("group_id"), "cell_id")


def merge_groups(groups: DataFrame, tree: DataFrame) -> DataFrame:
    """(group_id, cell_id): any cell groups, those that overlap merged into the one with most cells, accumulation, and id.

    Groups that share a cell are linked through the least of the cell's groups; labels
    then run along the links, and each round takes the least label in reach.
    """
    g = cut(groups.select("group_id", "cell_id").distinct())
    label = cut(g.select("group_id").distinct().withColumn("label", F.col("group_id")))
    before = None
    while True:
        at_cell = g.join(label, "group_id").groupBy("cell_id").agg(F.min("label").alias("low"))
        label = cut(g.join(at_cell, "cell_id").groupBy("group_id").agg(F.min("low").alias("label")))
        # a label's own label: halves the way
        nxt = label.select(F.col("group_id").alias("label"), F.col("label").alias("_l"))
        label = cut(label.join(nxt, "label").select("group_id", F.col("_l").alias("label")))
        state = label.agg(F.sum("label")).first()[0]
        if state == before:
            break
        before = state
    size = g.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).join(tree.select(F.col("cell_id").alias("group_id"), "acc"), "group_id", "left").join(label, "group_id")
    parent = size.groupBy("label").agg(F.max(F.struct("n", F.coalesce("acc", F.lit(0)).alias("acc"), "group_id")).alias("m")).select("label", F.col("m.group_id").alias("parent"))
    return g.join(label, "group_id").join(parent, "label").select(F.col("parent").alias("group_id"), "cell_id").distinct()


def group_at(selection: DataFrame, cell: DataFrame) -> DataFrame:
    """(group_id) of the smallest group that holds the cell; ties by id."""
    sizes = selection.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    hit = selection.join(F.broadcast(cell.select("cell_id")), "cell_id").join(sizes, "group_id")  # one cell
    return hit.agg(F.min(F.struct("n", "group_id")).alias("m")).where("m is not null").select("m.group_id")


def selection_summary(selection: DataFrame, grid: Grid) -> DataFrame:
    """One row: groups, distinct cells, and their area."""
    return selection.agg(F.countDistinct("group_id").alias("n_groups"), F.countDistinct("cell_id").alias("n_cells")).withColumn("area_m2", F.col("n_cells") * F.lit(grid.cell_area))


def centroids(assigned: DataFrame, grid: Grid) -> DataFrame:
    """(outlet_id, x, y): centroids of unions of equal cells are the means of their centres."""
    return assigned.groupBy("outlet_id").agg(F.round(F.avg(G.centre_x(grid, F.col("cell_id"))), 6).alias("x"), F.round(F.avg(G.centre_y(grid, F.col("cell_id"))), 6).alias("y"))


def surface_points(assigned: DataFrame, grid: Grid) -> DataFrame:
    """(outlet_id, x, y): a point inside each subcatchment, the middle of the widest run of cells in the row nearest to half its height.

    Made to be inside, as a label point must be; not bit for bit what a geometry library gives.
    """
    from pyspark.sql import Window

    cell = F.col("cell_id")
    rc = assigned.select("outlet_id", G.row_of(grid, cell).alias("r"), G.col_of(grid, cell).alias("c"))
    span = rc.groupBy("outlet_id").agg(((F.min("r") + F.max("r")) / 2).alias("mid"))
    rows = rc.groupBy("outlet_id", "r").agg(F.count(F.lit(1)).alias("n")).join(span, "outlet_id")
    row = rows.groupBy("outlet_id").agg(F.min(F.struct(F.abs(F.col("r") - F.col("mid")).alias("d"), "r")).alias("m")).select("outlet_id", F.col("m.r").alias("r"))
    in_row = rc.join(row, ["outlet_id", "r"])
    runs = in_row.withColumn("run", F.col("c") - F.row_number().over(Window.partitionBy("outlet_id").orderBy("c")))
    wide = runs.groupBy("outlet_id", "r", "run").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"))
    best = wide.groupBy("outlet_id", "r").agg(F.max(F.struct("n", (-F.col("c0")).alias("k"))).alias("m"))
    c = -F.col("m.k") + F.col("m.n") / 2
    return best.select("outlet_id", (F.lit(float(grid.x0)) + c * F.lit(float(grid.dx))).alias("x"), (F.lit(float(grid.y0)) + (F.col("r") + 0.5) * F.lit(float(grid.dy))).alias("y"))
