"""The node-link network of subcatchments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions.lineage import cut
from talweg.functions.ordering import numbered
from talweg.operators import routing, trees
from talweg.sources.grid import Grid, TerrainError


def downstream_map(assigned: DataFrame, tree: DataFrame) -> DataFrame:
    """(outlet_id, ds_id): the subcatchment that holds the cell below each outlet; null for a sink."""
    outlets = assigned.select("outlet_id").distinct()
    below = tree.select(F.col("cell_id").alias("outlet_id"), F.col("down_id").alias("cell_id"))
    owner = assigned.select("cell_id", F.col("outlet_id").alias("ds_id"))
    return outlets.join(below, "outlet_id").join(owner, "cell_id", "left").select("outlet_id", "ds_id")


def with_depth(links: DataFrame) -> DataFrame:
    """links (outlet_id, ds_id) with depth, the steps to the sink. Ways are halved each round; a loop raises."""
    state = cut(links.select("outlet_id", F.col("ds_id").alias("to"), F.col("ds_id").isNotNull().cast("long").alias("depth")))
    n, rounds = state.count(), 0
    while not state.where("to is not null").isEmpty():
        if 1 << rounds > 2 * n:
            raise TerrainError("the subcatchments drain in a loop")
        far = state.select(F.col("outlet_id").alias("_n"), F.col("to").alias("_to"), F.col("depth").alias("_depth"))
        state = cut(state.join(far, F.col("to") == F.col("_n"), "left").select("outlet_id", F.col("_to").alias("to"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
        rounds += 1
    return links.join(state.select("outlet_id", "depth"), "outlet_id")


def depth_order(links: DataFrame, tree: DataFrame) -> DataFrame:
    """(outlet_id, ds_id, acc, depth, position): upstream first; position counts by depth, accumulation and id. A row for each subcatchment."""
    got = with_depth(links).join(tree.select(F.col("cell_id").alias("outlet_id"), "acc"), "outlet_id")
    return numbered(got, "position", F.desc("depth"), "acc", "outlet_id").select("outlet_id", "ds_id", "acc", "depth", "position")


def require_one_terminal(links: DataFrame) -> None:
    n = links.where("ds_id is null").count()
    if n != 1:
        raise TerrainError("no subcatchment is a sink" if n == 0 else f"{n} subcatchments are sinks; a model needs one: draw the outlet line across a single stream")


def receivers_set(links: DataFrame) -> DataFrame:
    """(outlet_id) of subcatchments into which others drain: those that need a stream segment."""
    return links.where("ds_id is not null").select(F.col("ds_id").alias("outlet_id")).distinct()


def display_scale(points: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """points (node_id, x, y) with sx, sy on a window from 0 to 100, over all points and, if given, extra ones (x, y)."""
    every = points.select("x", "y") if extra is None else points.select("x", "y").unionByName(extra.select("x", "y"))
    box = every.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    scaled = lambda v, a, b: (F.col(v) - F.col(a)) / F.greatest(F.col(b) - F.col(a), F.lit(1.0)) * 90 + 2.5
    return points.crossJoin(F.broadcast(box)).select("node_id", "x", "y", scaled("x", "x0", "x1").alias("sx"), scaled("y", "y0", "y1").alias("sy"))  # box: one row


def _local_ways(cell: np.ndarray, down: np.ndarray, stop: np.ndarray, heads: np.ndarray) -> list[list[int]]:
    """The cells from each head to the first stop, or to the last cell of the tile."""
    nxt = np.where(stop, -1, trees.places(cell, down)).tolist()
    out = []
    for at in heads.tolist():
        way = []
        while at >= 0:
            way.append(at)
            at = nxt[at]
        out.append(cell[way].tolist())
    return out


def outlet_paths(assigned: DataFrame, tree: DataFrame, grid: Grid, model_outlet: int | None = None, tile_cells: int = routing.TILE_CELLS) -> DataFrame:
    """(outlet_id, ds_id, cells): each subcatchment outlet's way, from itself to the next outlet, the model outlet, or the first cell outside.

    A way is followed tile by tile: a task knows, for the cells at which ways or water enter
    its tile, where they leave it; which tiles a way passes is found by doubling, and the
    cells in them come from the tasks of these tiles. So a basin of any size is many tasks.
    The model outlet ends a way even where it is an outlet itself; such ways have no ds_id
    and lead to the model's outlet node.
    """
    m = -1 if model_outlet is None else int(model_outlet)
    outlets = assigned.select("outlet_id").distinct()
    starts = outlets.join(tree.select(F.col("cell_id").alias("outlet_id"), F.col("down_id").alias("entry")), "outlet_id")
    owner = assigned.select(F.col("cell_id").alias("entry"), F.col("outlet_id").alias("owner"))
    starts = cut(starts.join(owner, "entry", "left").select("outlet_id", "entry", F.when(F.col("outlet_id") == m, F.lit(None)).otherwise(F.col("owner")).alias("owner")))
    ended = starts.where("owner is null").select("outlet_id", F.lit(None).cast("long").alias("ds_id"), F.when((F.col("entry") >= 0) & (F.col("outlet_id") != m), F.array("outlet_id", "entry")).otherwise(F.array("outlet_id")).alias("cells"))
    going = starts.where("owner is not null")
    tile = lambda c: routing.tile_of(grid, F.col(c), tile_cells)
    stop = (F.col("cell_id") == F.col("outlet_id")) | (F.col("cell_id") == m)
    links = cut(assigned.join(tree.select("cell_id", "down_id"), "cell_id").select("cell_id", "down_id", stop.alias("stop"), tile("cell_id").alias("tile")))
    across = links.where((F.col("down_id") >= 0) & ~F.col("stop") & (tile("down_id") != F.col("tile"))).select(F.col("down_id").alias("cell_id"))
    heads = across.union(going.select(F.col("entry").alias("cell_id"))).distinct().withColumn("head", F.lit(True))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        cell, down, stop = pdf.cell_id.to_numpy(), pdf.down_id.to_numpy(), pdf.stop.to_numpy().astype(bool)
        last = trees.local_last(trees.places(cell, down), stop)
        some = np.flatnonzero(pdf["head"].notna())
        to = np.where(stop[last], -1, down[last])[some]
        return pd.DataFrame({"head": cell[some], "nxt": pd.array(np.where(to < 0, 0, to), "Int64"), "ends": to < 0})

    jump = links.join(heads, "cell_id", "left").groupBy("tile").applyInPandas(ends, "head long, nxt long, ends boolean")
    jump = cut(jump.select("head", F.when(~F.col("ends"), F.col("nxt")).alias("nxt")))
    parts, steps = cut(going.select("outlet_id", F.col("entry").alias("head"), F.lit(0).cast("long").alias("d"))), 1
    while True:  # parts holds the first ``steps`` heads of each way; jump leads as many heads on
        more = cut(parts.join(jump, "head").where("nxt is not null").select("outlet_id", F.col("nxt").alias("head"), (F.col("d") + steps).alias("d")))
        if more.isEmpty():
            break
        parts = cut(parts.unionByName(more))
        far = jump.select(F.col("head").alias("_h"), F.col("nxt").alias("_n"))
        jump = cut(jump.join(far, F.col("nxt") == F.col("_h"), "left").select("head", F.col("_n").alias("nxt")))
        steps *= 2
    used = parts.select(F.col("head").alias("cell_id")).distinct().withColumn("head", F.lit(True))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        cell, some = pdf.cell_id.to_numpy(), np.flatnonzero(pdf["head"].notna())
        ways = _local_ways(cell, pdf.down_id.to_numpy(), pdf.stop.to_numpy().astype(bool), some)
        return pd.DataFrame({"head": cell[some], "way": pd.Series(ways, dtype=object)})

    ways = links.join(used, "cell_id", "left").groupBy("tile").applyInPandas(walk, "head long, way array<long>")
    whole = parts.join(ways, "head").groupBy("outlet_id").agg(F.sort_array(F.collect_list(F.struct("d", "way"))).alias("w"))
    cells = F.concat(F.array("outlet_id"), F.flatten(F.transform("w", lambda x: x["way"])))
    walked = whole.join(going.select("outlet_id", "owner"), "outlet_id").select("outlet_id", "owner", cells.alias("cells"))
    return ended.unionByName(walked.select("outlet_id", F.when(F.element_at("cells", -1) != m, F.col("owner")).alias("ds_id"), "cells"))


def path_measures(paths: DataFrame, grid, end_point: tuple[float, float]) -> DataFrame:
    """(outlet_id, ds_id, length_m, mid_x, mid_y) of the ways; those without ds_id go on to the model's outlet node at end_point."""
    from talweg.functions import geometry as G

    end = G.point(F.lit(float(end_point[0])), F.lit(float(end_point[1])))
    points = F.transform("cells", lambda c: G.centre(grid, c))
    points = F.when(F.col("ds_id").isNull(), F.concat(points, F.array(end))).otherwise(points)
    p = paths.select("outlet_id", "ds_id", points.alias("p"))
    # consecutive equal points count once; a way of one point gets a short stub
    step = lambda i: F.hypot(F.element_at("p", i + 1)["x"] - F.element_at("p", i)["x"], F.element_at("p", i + 1)["y"] - F.element_at("p", i)["y"])
    steps = F.when(F.size("p") > 1, F.transform(F.sequence(F.lit(1), F.size("p") - 1), step)).otherwise(F.array().cast("array<double>"))
    p = p.withColumn("steps", steps).withColumn("length", F.aggregate("steps", F.lit(0.0), lambda a, v: a + v))
    stub = max(grid.cell_width, grid.cell_height, 1.0) * 0.25
    half = F.col("length") / 2
    # walk: (done, index of the segment that holds the middle, way along it)
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("i"), F.lit(-1.0).alias("t"))
    found = F.aggregate(
        "steps",
        start,
        lambda a, v: F.struct(
            F.when((a["t"] >= 0) | (v <= 0), a["w"]).otherwise(a["w"] + v).alias("w"),
            F.when(a["t"] >= 0, a["i"]).otherwise(a["i"] + 1).alias("i"),
            F.when(a["t"] >= 0, a["t"]).when((v > 0) & (a["w"] + v >= half), (half - a["w"]) / v).otherwise(F.lit(-1.0)).alias("t"),
        ),
    )
    p = p.withColumn("f", found)
    a, b = F.element_at("p", F.greatest(F.col("f.i"), F.lit(1))), F.element_at("p", F.least(F.col("f.i") + 1, F.size("p")))
    mid = lambda k: F.when(F.col("length") > 0, a[k] + (b[k] - a[k]) * F.col("f.t")).otherwise(F.element_at("p", 1)[k] + (stub / 2 if k == "x" else -stub / 2))
    length = F.when(F.col("length") > 0, F.col("length")).otherwise(F.lit(float((2 * stub * stub) ** 0.5)))
    return p.select("outlet_id", "ds_id", length.alias("length_m"), mid("x").alias("mid_x"), mid("y").alias("mid_y"))
