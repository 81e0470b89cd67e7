"""Flow paths, stream order and reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions import geometry as G
from talweg.functions.ordering import numbered
from talweg.operators.trees import Strahler, first_stop, fold, upstream_sums
from talweg.sources.grid import Grid


def accumulation(receivers: DataFrame, grid: Grid, **kw) -> DataFrame:
    """(cell_id, down_id, acc): cells that drain through each cell, itself included."""
    return upstream_sums(receivers.select("cell_id", "down_id", F.lit(1).cast("long").alias("w")), grid, **kw).withColumnRenamed("total", "acc")


def strahler(tree: DataFrame, grid: Grid, **kw) -> DataFrame:
    """(cell_id, strahler) of all cells of tree (cell_id, down_id, acc)."""
    return fold(tree, grid, Strahler, **kw).select("cell_id", F.col("value").cast("int").alias("strahler"))


def displayed(tree: DataFrame, min_acc: int) -> DataFrame:
    """Cells that are shown as flow paths: outlets never are."""
    return tree.where((F.col("down_id") >= 0) & (F.col("acc") >= int(min_acc))).select("cell_id", "down_id", "acc")


def stream_strahler(shown: DataFrame, grid: Grid, **kw) -> DataFrame:
    """(cell_id, strahler) on the displayed cells alone."""
    return strahler(shown, grid, **kw)


def flow_paths(tree: DataFrame, grid: Grid, min_acc: int, orders: DataFrame | None = None) -> DataFrame:
    """The flow path layer: cell_id, row, col, down_id, acc_cells, strahler, length_m."""
    shown = displayed(tree, min_acc)
    orders = stream_strahler(shown, grid) if orders is None else orders
    cell = F.col("cell_id")
    return shown.join(orders, "cell_id").select(
        "cell_id",
        G.row_of(grid, cell).cast("int").alias("row"),
        G.col_of(grid, cell).cast("int").alias("col"),
        "down_id",
        F.col("acc").alias("acc_cells"),
        "strahler",
        F.round(G.segment_length(grid, cell, F.col("down_id")), 2).alias("length_m"),
    )


def in_layer_order(paths: DataFrame) -> DataFrame:
    return paths.orderBy("strahler", "acc_cells", "cell_id")


def path_lines(paths: DataFrame, grid: Grid) -> DataFrame:
    """paths with their line, from a cell's centre to the next one's."""
    return paths.withColumn("line", F.array(G.centre(grid, F.col("cell_id")), G.centre(grid, F.col("down_id"))))


def merge_links(paths: DataFrame) -> DataFrame:
    """paths with _next: the next cell of the same reach, which is displayed, has the same order, and one parent of that order; else -1."""
    mine = paths.select("cell_id", "down_id", "acc_cells", "strahler")
    kin = mine.groupBy("down_id", "strahler").agg(F.count(F.lit(1)).alias("_kin")).select(F.col("down_id").alias("_d"), F.col("strahler").alias("_s"), "_kin")
    below = mine.select(F.col("cell_id").alias("_d"), F.col("strahler").alias("_s"))
    one = below.join(kin.where("_kin = 1"), ["_d", "_s"])
    return mine.join(one, (F.col("down_id") == F.col("_d")) & (F.col("strahler") == F.col("_s")), "left").select(*mine.columns, F.coalesce("_d", F.lit(-1)).alias("_next"))


def reach_cells(paths: DataFrame, grid: Grid) -> DataFrame:
    """paths' cells with _end, the last cell of their reach. The orders are taken as they stand in paths."""
    linked = merge_links(paths)
    ends = first_stop(linked.select("cell_id", F.col("_next").alias("down_id"), (F.col("_next") < 0).alias("stop")), grid)
    return linked.drop("_next").join(ends.withColumnRenamed("stop", "_end"), "cell_id")


def reaches(paths: DataFrame, grid: Grid, recompute_order: bool = True) -> DataFrame:
    """The reach layer: reach_id, start_cell, end_cell, cell_count, from_acc, to_acc, strahler, length_m.

    Orders are computed again on the displayed cells first, as paths may have been cut to a
    domain. Numbers follow (order, accumulation and id of the first cell); there is a row
    for each reach by then, not for each cell.
    """
    if recompute_order:
        again = stream_strahler(paths.select("cell_id", "down_id", F.col("acc_cells").alias("acc")), grid)
        paths = paths.drop("strahler").join(again, "cell_id")
    cells = reach_cells(paths, grid)
    made = cells.groupBy("_end").agg(
        F.min_by("cell_id", "acc_cells").alias("start_cell"),
        F.count(F.lit(1)).alias("cell_count"),
        F.min("acc_cells").alias("from_acc"),
        F.max("acc_cells").alias("to_acc"),
        F.first("strahler").alias("strahler"),
        F.round(F.sum(G.segment_length(grid, F.col("cell_id"), F.col("down_id"))), 2).alias("length_m"),
    )
    return numbered(made, "reach_id", "strahler", "from_acc", "start_cell").select("reach_id", "start_cell", F.col("_end").alias("end_cell"), "cell_count", "from_acc", "to_acc", "strahler", "length_m")


def reach_lines(paths: DataFrame, grid: Grid, reach_layer: DataFrame) -> DataFrame:
    """(reach_id, line): each reach's points in order, with the cell after the last. A reach is one line, so it is collected as one."""
    cells = reach_cells(paths, grid).join(reach_layer.select("reach_id", F.col("end_cell").alias("_end")), "_end")
    points = cells.groupBy("reach_id").agg(F.sort_array(F.collect_list(F.struct("acc_cells", "cell_id", "down_id"))).alias("c"))
    line = F.concat(F.transform("c", lambda x: G.centre(grid, x["cell_id"])), F.array(G.centre(grid, F.element_at("c", -1)["down_id"])))
    return points.select("reach_id", line.alias("line"))


def style(paths: DataFrame) -> DataFrame:
    """(strahler, red, green, blue, width): darker and wider with the order; one row for each order."""
    light, dark = (190, 222, 246), (0, 32, 95)  # fixed values
    orders = paths.select("strahler").where("strahler >= 1").distinct()
    span = orders.agg(F.min("strahler").alias("lo"), F.max("strahler").alias("hi"))
    t = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((F.col("strahler") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    rgb = [(F.lit(a) + F.lit(b - a) * t).cast("int").alias(n) for a, b, n in zip(light, dark, ("red", "green", "blue"))]
    return orders.crossJoin(F.broadcast(span)).select("strahler", *rgb, (F.lit(0.25) + F.least("strahler", F.lit(12)) * 0.12).alias("width"))  # span: one row
