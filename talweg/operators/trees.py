"""Sums, searches and folds over the receiver forest, at any size.

A tile's paths are followed inside one task on arrays. What is left is the graph of the
cells at which water enters a tile; its paths are halved each round on DataFrames, so the
rounds grow with the logarithm of the number of tiles on a path. The results then go back
into the tiles. Cells are shuffled twice, never once for each step downstream.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions.lineage import cut, drop_cut
from talweg.operators.routing import TILE_CELLS, one_tile, tile_of
from talweg.sources.grid import Grid

BAND = 1 << 14  # accumulations of a factor BAND are folded in one pass
TASK_CELLS = 100_000  # of a fold's task, about


def places(cell: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Index of each next cell in the sorted ``cell``; -1 if it is elsewhere."""
    at = np.minimum(np.searchsorted(cell, nxt), len(cell) - 1)
    return np.where((nxt >= 0) & (cell[at] == nxt), at, -1)


def _local_sums(nxt: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of w over all paths that lead to each place, itself included; paths are halved each round."""
    total, jump = w.copy(), nxt.copy()
    while (live := jump >= 0).any():
        np.add.at(add := np.zeros_like(total), jump[live], total[live])
        total = total + add
        jump = np.where(live, jump[np.maximum(jump, 0)], -1)
    return total


def local_last(nxt: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first stop on the way of each place, or else the last place of its way."""
    to = np.where(stop | (nxt < 0), np.arange(len(nxt)), nxt)
    while (further := to[to] != to).any():
        to = to[to]
    return to


def _double(nodes: DataFrame) -> DataFrame:
    """(node, stop): nodes (node, to, found) with paths halved until each has its stop (found) or null."""
    state = cut(nodes)
    while not state.where("to is not null and not found").isEmpty():
        far = state.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("found").alias("_found"))
        going = state.where("to is not null and not found").join(far, F.col("to") == F.col("_n"), "left").select("node", F.col("_to").alias("to"), F.coalesce("_found", F.lit(False)).alias("found"))
        after = cut(state.where("to is null or found").unionByName(going))
        drop_cut(state)
        state = after
    return state.select("node", F.when(F.col("found"), F.col("to")).alias("stop"))


def _forest_sums(nodes: DataFrame) -> DataFrame:
    """(node, total): sums of w over all nodes upstream of each node (node, to, w), itself included."""
    state = cut(nodes.select("node", "to", "w"))
    while not state.where("to is not null").isEmpty():
        add = state.where("to is not null").groupBy(F.col("to").alias("node")).agg(F.sum("w").alias("_add"))
        far = state.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
        after = state.join(add, "node", "left").join(far, F.col("to") == F.col("_n"), "left")
        after = cut(after.select("node", F.col("_to").alias("to"), (F.col("w") + F.coalesce("_add", F.lit(0))).alias("w")))
        drop_cut(state)
        state = after
    return state.select("node", F.col("w").alias("total"))


def upstream_sums(links: DataFrame, grid: Grid, tile_cells: int = TILE_CELLS) -> DataFrame:
    """(cell_id, down_id, total): of links (cell_id, down_id, w), the sum of w over each cell and all cells that drain through it."""
    tiled = links.select("cell_id", "down_id", F.col("w").cast("long").alias("w"), tile_of(grid, F.col("cell_id"), tile_cells).alias("tile"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        cell, down = pdf.cell_id.to_numpy(), pdf.down_id.to_numpy()
        nxt = places(cell, down)
        last = local_last(nxt, np.zeros(len(cell), bool))
        return pd.DataFrame({"cell_id": cell, "down_id": down, "w": _local_sums(nxt, pdf.w.to_numpy()), "leaves_to": np.where(down[last] >= 0, down[last], -1), "last": cell[last], "tile": pdf.tile})

    inside = tiled.groupBy("tile").applyInPandas(local, "cell_id long, down_id long, w long, leaves_to long, last long, tile long")
    if one_tile(grid, tile_cells):
        return inside.select("cell_id", "down_id", F.col("w").alias("total"))
    inside = cut(inside)
    # entries: cells into which another tile drains, with what its own cells bring
    entries = inside.where("cell_id = last and leaves_to >= 0").groupBy(F.col("leaves_to").alias("node")).agg(F.sum("w").alias("w"))
    nodes = entries.join(inside.select(F.col("cell_id").alias("node"), F.when(F.col("leaves_to") >= 0, F.col("leaves_to")).alias("to")), "node")
    inflow = _forest_sums(nodes).select(F.col("node").alias("cell_id"), F.col("total").alias("_in"))

    def spread(pdf: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        cell, down, w = pdf.cell_id.to_numpy(), pdf.down_id.to_numpy(), pdf.w.to_numpy().copy()
        w[np.searchsorted(cell, entered.cell_id.to_numpy(np.int64))] += entered["_in"].to_numpy(np.int64)
        return pd.DataFrame({"cell_id": cell, "down_id": down, "total": _local_sums(places(cell, down), w)})

    # inflows meet the cells in their tile, so that cells are shuffled by tile alone
    entered = inflow.withColumn("tile", tile_of(grid, F.col("cell_id"), tile_cells))
    return tiled.groupBy("tile").cogroup(entered.groupBy("tile")).applyInPandas(spread, "cell_id long, down_id long, total long")


def first_stop(links: DataFrame, grid: Grid, tile_cells: int = TILE_CELLS) -> DataFrame:
    """(cell_id, stop): of links (cell_id, down_id, stop), the first cell marked ``stop`` on each cell's way, itself included; null without one."""
    tiled = links.select("cell_id", "down_id", "stop", tile_of(grid, F.col("cell_id"), tile_cells).alias("tile"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        cell, down, stop = pdf.cell_id.to_numpy(), pdf.down_id.to_numpy(), pdf.stop.to_numpy().astype(bool)
        last = local_last(places(cell, down), stop)
        to = np.where(stop[last], cell[last], down[last])
        return pd.DataFrame({"node": cell, "to": pd.array(np.maximum(to, 0), "Int64"), "none": to < 0, "found": stop[last]})

    inside = tiled.groupBy("tile").applyInPandas(local, "node long, to long, none boolean, found boolean")
    inside = inside.select("node", F.when(~F.col("none"), F.col("to")).alias("to"), "found")
    if one_tile(grid, tile_cells):
        return inside.select(F.col("node").alias("cell_id"), F.when(F.col("found"), F.col("to")).alias("stop"))
    inside = cut(inside)
    open_ = inside.where("to is not null and not found")
    entries = inside.join(open_.select(F.col("to").alias("node")).distinct(), "node", "left_semi")
    solved = _double(entries).select(F.col("node").alias("to"), F.col("stop").alias("_stop"))
    rest = open_.join(solved, "to", "left").select("node", F.col("_stop").alias("stop"))
    done = inside.where("to is null or found").select("node", F.when(F.col("found"), F.col("to")).alias("stop"))
    return done.unionByName(rest).withColumnRenamed("node", "cell_id")


def last_stop(links: DataFrame, marks: DataFrame, grid: Grid, tile_cells: int = TILE_CELLS) -> DataFrame:
    """(cell_id, stop): of links (cell_id, down_id), the last of the cells of marks (cell_id) on each cell's way, itself included; null without one. Marks meet the links in their tile."""
    tile = tile_of(grid, F.col("cell_id"), tile_cells).alias("tile")

    def local(pdf: pd.DataFrame, marked: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        cell, down = pdf.cell_id.to_numpy(np.int64), pdf.down_id.to_numpy(np.int64)
        if not len(cell):
            return pd.DataFrame({"node": cell, "to": cell, "mark": cell})
        nxt = places(cell, down)
        leaves_to = down[local_last(nxt, np.zeros(len(cell), bool))]
        mark, jump = np.where(np.isin(cell, marked.cell_id.to_numpy(np.int64)), cell, -1), nxt
        while (live := jump >= 0).any():
            further = np.where(live, mark[np.maximum(jump, 0)], -1)
            mark = np.where(further >= 0, further, mark)
            jump = np.where(live, jump[np.maximum(jump, 0)], -1)
        return pd.DataFrame({"node": cell, "to": leaves_to, "mark": mark})

    sides = links.select("cell_id", "down_id", tile).groupBy("tile"), marks.select("cell_id", tile).groupBy("tile")
    inside = sides[0].cogroup(sides[1]).applyInPandas(local, "node long, to long, mark long")
    inside = inside.select("node", *(F.when(F.col(x) >= 0, F.col(x)).alias(x) for x in ("to", "mark")))
    if one_tile(grid, tile_cells):
        return inside.select(F.col("node").alias("cell_id"), F.col("mark").alias("stop"))
    inside = cut(inside)
    open_ = inside.where("to is not null")
    state = cut(inside.join(open_.select(F.col("to").alias("node")).distinct(), "node", "left_semi"))
    while not state.where("to is not null").isEmpty():
        far = state.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("mark").alias("_mark"))
        after = cut(state.join(far, F.col("to") == F.col("_n"), "left").select("node", F.col("_to").alias("to"), F.coalesce("_mark", "mark").alias("mark")))
        drop_cut(state)
        state = after
    solved = state.select(F.col("node").alias("to"), F.col("mark").alias("_mark"))
    rest = open_.join(solved, "to", "left").select("node", F.coalesce("_mark", "mark").alias("stop"))
    done = inside.where("to is null").select("node", F.col("mark").alias("stop"))
    return done.unionByName(rest).withColumnRenamed("node", "cell_id")


class Strahler:
    """The largest of the values given to a cell, or one more if it was given twice; 1 without any."""

    def __init__(self, n: int):
        self.top, self.times = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def give(self, at: np.ndarray, v: np.ndarray) -> None:
        before = self.top[at]
        np.maximum.at(self.top, at, v)
        self.times[at[self.top[at] > before]] = 0
        np.add.at(self.times, at, v == self.top[at])

    def value(self, at: np.ndarray) -> np.ndarray:
        return np.where(self.top[at] > 0, self.top[at] + (self.times[at] > 1), 1)


class OpenCells:
    """One more than the sum of the values given to a cell that are below ``least``."""

    def __init__(self, n: int, least: int):
        self.sum, self.least = np.zeros(n, np.int64), least

    def give(self, at: np.ndarray, v: np.ndarray) -> None:
        np.add.at(self.sum, at, np.where(v < self.least, v, 0))

    def value(self, at: np.ndarray) -> np.ndarray:
        return self.sum[at] + 1


def fold_arrays(nxt: np.ndarray, state) -> np.ndarray:
    """Values of all cells from the leaves on; nxt: each cell's place to drain to, or -1. All cells whose feeders are done are taken together."""
    out, waiting = np.zeros(len(nxt), np.int64), np.bincount(nxt[nxt >= 0], minlength=len(nxt))
    ready = np.flatnonzero(waiting == 0)
    while len(ready):
        out[ready] = state.value(ready)
        on = ready[nxt[ready] >= 0]
        to = nxt[on]
        state.give(to, out[on])
        np.subtract.at(waiting, to, 1)
        to = np.unique(to)
        ready = to[waiting[to] == 0]
    return out


def fold(tree: DataFrame, grid: Grid, start: Callable[[int], object], band: int = BAND, tile_cells: int = TILE_CELLS) -> DataFrame:
    """(cell_id, value): each cell's value from those of the cells that drain into it, for tree (cell_id, down_id, acc) in which acc rises downstream.

    start(n) makes the state of n cells, such as Strahler or OpenCells: give() hands values
    on to cells, value() tells those of cells that have been given all of theirs.

    Cells are dealt into bands by acc. A band's cells form small trees with roots of their
    own, which are folded side by side in tasks of many trees; what a band hands on are
    the values that leave it, at most eight for a cell. So no task follows a large basin
    alone, and there are as many passes as bands.
    """
    width = float(np.log(band))
    tree = cut(tree.select("cell_id", "down_id", "acc", F.floor(F.log(F.col("acc").cast("double")) / width + 1e-9).cast("int").alias("band")))
    parent = tree.select(F.col("cell_id").alias("down_id"), F.col("band").alias("_parent_band"))
    linked = tree.join(parent, "down_id", "left")
    links = linked.select("cell_id", F.when(F.col("_parent_band") == F.col("band"), F.col("down_id")).otherwise(-1).alias("down_id"), (F.coalesce("_parent_band", F.lit(-1)) != F.col("band")).alias("stop"))
    tree = cut(tree.join(first_stop(links, grid, tile_cells).withColumnRenamed("stop", "root"), "cell_id"))
    done: DataFrame | None = None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        cell, down = pdf.cell_id.to_numpy(), pdf.down_id.to_numpy()
        state, given = start(len(cell)), pa.array(pdf.given, pa.list_(pa.int64()))
        size = pc.list_value_length(given).fill_null(0).to_numpy(zero_copy_only=False)
        if size.any():
            state.give(np.repeat(np.arange(len(cell)), size), pc.list_flatten(given).to_numpy())
        return pd.DataFrame({"cell_id": cell, "down_id": down, "value": fold_arrays(places(cell, down), state)})

    counts = {r.band: r.n for r in tree.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    bands = sorted(counts)
    for b in bands:
        groups = max(8, counts[b] // TASK_CELLS)
        mine = tree.where(F.col("band") == b)
        if done is None:
            mine = mine.withColumn("given", F.lit(None).cast("array<long>"))
        else:
            given = done.where("down_id >= 0").groupBy(F.col("down_id").alias("cell_id")).agg(F.collect_list("value").alias("given"))  # at most eight
            mine = mine.join(given, "cell_id", "left")
        part = cut(mine.withColumn("g", F.pmod(F.xxhash64("root"), F.lit(groups))).select("cell_id", "down_id", "acc", "given", "g").groupBy("g").applyInPandas(run, "cell_id long, down_id long, value long"))
        done = part if done is None else done.unionByName(part)
    if done is None:
        return tree.select("cell_id", F.lit(1).cast("long").alias("value"))
    return done.select("cell_id", "value")
