"""Flow routing: outlets, filled surface and receivers.

Every valid cell drains to the neighbour that a flood from the outlets reaches first.
Where the surface has no pits and no tied lowest neighbours that is the lowest neighbour,
which Spark finds with one aggregate. Pits and ties depend on the order of the flood, so
the exact receivers come from a heap kernel, one task for each DEM. The filled surface
alone takes three passes at any size and shape: tiles flood on their own, a graph of the
spills between what they found is solved, and its levels go back to the cells.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions.lineage import cut, drop_cut
from talweg.sources.grid import Grid, TerrainError

# Row and column steps to the neighbours, in the order in which the flood visits them: fixed values.
STEPS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
TILE_CELLS = 1 << 18


def tile_shape(grid: Grid, tile_cells: int = TILE_CELLS) -> tuple[int, int]:
    """Rows and columns of a tile: square blocks, whose borders are shortest, or all columns of a narrow grid."""
    width = min(grid.cols, max(1, math.isqrt(tile_cells)))
    return min(grid.rows, max(1, tile_cells // width)), width


def tile_at(grid: Grid, r, c, tile_cells: int = TILE_CELLS):
    rows, cols = tile_shape(grid, tile_cells)
    return (F.floor(r / rows) * -(-grid.cols // cols) + F.floor(c / cols)).cast("long")


def tile_of(grid: Grid, cell, tile_cells: int = TILE_CELLS):
    return tile_at(grid, F.floor(cell / grid.cols), F.pmod(cell, F.lit(grid.cols)), tile_cells)


def one_tile(grid: Grid, tile_cells: int = TILE_CELLS) -> bool:
    return tile_shape(grid, tile_cells) == (grid.rows, grid.cols)


def on_border(grid: Grid, cell, tile_cells: int = TILE_CELLS):
    """Whether a cell has neighbours in another tile."""
    rows, cols = tile_shape(grid, tile_cells)
    r, c = F.floor(cell / grid.cols), F.pmod(cell, F.lit(grid.cols))
    at = lambda x, n, most: ((F.pmod(x, F.lit(n)) == 0) & (x > 0)) | ((F.pmod(x, F.lit(n)) == n - 1) & (x < most - 1))
    return at(r, rows, grid.rows) | at(c, cols, grid.cols)


def with_halo(cells: DataFrame, grid: Grid, tile_cells: int = TILE_CELLS) -> DataFrame:
    """cells with their tile (own is true), and border cells once more for each other tile beside them (own is false)."""
    r, c = F.floor(F.col("cell_id") / grid.cols), F.pmod("cell_id", F.lit(grid.cols))
    beside = F.array(*(F.when((r + dr).between(0, grid.rows - 1) & (c + dc).between(0, grid.cols - 1), tile_at(grid, r + dr, c + dc, tile_cells)) for dr, dc in STEPS))
    mine = cells.withColumn("tile", tile_of(grid, F.col("cell_id"), tile_cells))
    if one_tile(grid, tile_cells):
        return mine.withColumn("own", F.lit(True))
    copies = F.array_distinct(F.filter(beside, lambda t: t.isNotNull() & (t != F.col("tile"))))
    halo = mine.where(on_border(grid, F.col("cell_id"), tile_cells)).withColumn("tile", F.explode(copies))
    return mine.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)))


def to_neighbours(cells: DataFrame, grid: Grid) -> DataFrame:
    """Each cell offered to its neighbours: target, cell_id, z. One narrow step; targets may be invalid."""
    c = F.pmod("cell_id", F.lit(grid.cols))
    steps = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in STEPS))
    spread = cells.select("cell_id", "z", c.alias("c"), F.explode(steps).alias("s"))
    inside = (F.col("c") + F.col("s.dc")).between(0, grid.cols - 1)
    target = F.col("cell_id") + F.col("s.dr") * grid.cols + F.col("s.dc")
    return spread.where(inside).select(target.alias("target"), "cell_id", "z").where(F.col("target").between(0, grid.rows * grid.cols - 1))


def neighbours(cells: DataFrame, grid: Grid) -> DataFrame:
    """(cell_id, nbr_id, nbr_z) of valid neighbours of valid cells."""
    offered = to_neighbours(cells, grid).select(F.col("target").alias("cell_id"), F.col("cell_id").alias("nbr_id"), F.col("z").alias("nbr_z"))
    return offered.join(cells.select("cell_id"), "cell_id")


def with_best_neighbour(cells: DataFrame, grid: Grid, tile_cells: int = TILE_CELLS) -> DataFrame:
    """(cell_id, z) with n_nbrs, the lowest neighbour (best_id, best_z; ties by the smaller id), and how many neighbours tie for it. Tiles and their halos are looked at on arrays."""
    cols = grid.cols

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, z, own = pdf.cell_id.to_numpy(), pdf.z.to_numpy(), pdf.own.to_numpy()
        r, c = cell // cols, cell % cols
        width = int(c.max() - c.min()) + 3  # a frame of invalid cells saves the border tests
        at = (r - r.min() + 1) * width + c - c.min() + 1
        level = np.full((int(r.max() - r.min()) + 3) * width, np.nan)
        level[at] = z
        at, cell = at[own], cell[own]
        n, ties = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        best, best_id = np.full(len(at), np.inf), np.full(len(at), -1)
        for dr, dc in STEPS:  # by rising ids
            seen = level[at + dr * width + dc]
            lower = seen < best
            n += ~np.isnan(seen)
            ties = np.where(lower, 1, ties + (seen == best))
            best, best_id = np.where(lower, seen, best), np.where(lower, cell + dr * cols + dc, best_id)
        return pd.DataFrame({"cell_id": cell, "z": z[own], "n_nbrs": n, "best_id": best_id, "best_z": best, "n_best": ties})

    halo = with_halo(cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("z").cast("double").alias("z")), grid, tile_cells)
    got = halo.groupBy("tile").applyInPandas(local, "cell_id long, z double, n_nbrs long, best_id long, best_z double, n_best int")
    return got.select("cell_id", "z", "n_nbrs", *(F.when(F.col("n_nbrs") > 0, F.col(x)).alias(x) for x in ("best_id", "best_z", "n_best")))


def seeds(cells: DataFrame, grid: Grid) -> DataFrame:
    """(cell_id, z) of outlets: valid cells on the grid's edge or beside an invalid cell, that is with fewer than eight valid neighbours."""
    return with_best_neighbour(cells, grid).where("n_nbrs < 8").select("cell_id", "z")


def receivers_by_lowest(cells: DataFrame, grid: Grid, check: bool = True) -> DataFrame:
    """(cell_id, down_id) with -1 at outlets, for a surface without pits and tied lowest neighbours; check raises on any other."""
    best = with_best_neighbour(cells, grid)
    if check:
        best = cut(best)
        bad = best.where((F.col("n_nbrs") == 8) & ((F.col("best_z") >= F.col("z")) | (F.col("n_best") > 1))).limit(1).collect()
        if bad:
            raise TerrainError(f"cell {bad[0].cell_id} is in a pit or has tied lowest neighbours: its receiver depends on the flood's order")
    return best.select("cell_id", F.when(F.col("n_nbrs") < 8, F.lit(-1)).otherwise(F.col("best_id")).cast("long").alias("down_id"))


def flood_kernel(cell_id: np.ndarray, z: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Receiver, filled elevation and pop rank of each valid cell of one DEM.

    A heap of (spill elevation, push number) starts with all outlets in the order of their
    ids; a popped cell becomes the receiver of its unvisited neighbours.
    """
    width = cols + 2  # a frame of invalid cells saves the border tests
    at = (cell_id // cols + 1) * width + cell_id % cols + 1
    elevation = np.full((rows + 2) * width, np.nan)
    elevation[at] = z
    valid = np.zeros(len(elevation), bool)
    valid[at] = True
    jumps = [dr * width + dc for dr, dc in STEPS]
    inner = np.ones(len(at), bool)
    for j in jumps:
        inner &= valid[at + j]
    level, is_open = elevation.tolist(), valid.tolist()
    down, filled, rank = [-1] * len(level), list(level), [-1] * len(level)
    heap = [(level[s], k, s) for k, s in enumerate(np.sort(at[~inner]).tolist())]
    for _, _, s in heap:
        is_open[s] = False
    heapq.heapify(heap)
    pushed, popped = len(heap), 0
    while heap:
        e, _, s = heapq.heappop(heap)
        rank[s] = popped
        popped += 1
        for j in jumps:
            n = s + j
            if is_open[n]:
                is_open[n] = False
                down[n] = s
                spill = level[n] if level[n] > e else e
                filled[n] = spill
                heapq.heappush(heap, (spill, pushed, n))
                pushed += 1
    if popped != len(at):
        raise TerrainError("a cell was not reached from any outlet")
    down = np.array(down)[at]
    back = np.where(down < 0, -1, (down // width - 1) * cols + down % width - 1)
    return back, np.array(filled)[at], np.array(rank)[at]


def flood(cells: DataFrame, grid: Grid) -> DataFrame:
    """(dem_id, cell_id, down_id, filled, pop_rank): the exact flood of each DEM, one task a DEM. Without a dem_id column all cells are one DEM."""
    rows, cols = grid.rows, grid.cols

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        down, filled, rank = flood_kernel(pdf.cell_id.to_numpy(), pdf.z.to_numpy(), rows, cols)
        return pd.DataFrame({"dem_id": pdf.dem_id, "cell_id": pdf.cell_id, "down_id": down, "filled": filled, "pop_rank": rank})

    named = cells if "dem_id" in cells.columns else cells.withColumn("dem_id", F.lit("dem"))
    return named.select("dem_id", "cell_id", "z").groupBy("dem_id").applyInPandas(run, "dem_id string, cell_id long, down_id long, filled double, pop_rank long")


OCEAN = -1  # label of what drains out of the grid
SPILLS = 500_000  # spills from which the graph is solved on the driver


def _flood_tile(cell: np.ndarray, z: np.ndarray, own: np.ndarray, border: np.ndarray, cols: int) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Label and level of each own cell of a tile, and the least spill between labels.

    The tile floods from its outlets, which are ocean, and from its border cells, lowest
    first; a border cell that no other has flooded gives its id as label. A level is the
    least elevation from which water reaches the label's first cell inside the tile.
    """
    r0, r1, c0, c1 = (int(f(x)) for x in (cell // cols, cell % cols) for f in (np.min, np.max))
    width = c1 - c0 + 3
    at = (cell // cols - r0 + 1) * width + cell % cols - c0 + 1
    n = (r1 - r0 + 3) * width
    valid = np.zeros(n, bool)
    valid[at] = True
    jumps = [dr * width + dc for dr, dc in STEPS]
    inner = np.ones(len(at), bool)
    for j in jumps:
        inner &= valid[at + j]
    mine, elevation, outlet = np.zeros(n, bool), np.zeros(n), np.zeros(n, bool)
    mine[at[own]] = True
    elevation[at] = z
    outlet[at[own & ~inner]] = True
    ids = np.zeros(n, np.int64)
    ids[at] = cell
    ok, level, label, name = mine.tolist(), elevation.tolist(), np.where(outlet, OCEAN, -2).tolist(), ids.tolist()
    heap = [(level[p], p) for p in at[own & (~inner | border)].tolist()]
    heapq.heapify(heap)
    done, spills = [False] * n, {}
    while heap:
        e, p = heapq.heappop(heap)
        if done[p]:
            continue
        done[p] = True
        if label[p] == -2:
            label[p] = name[p]
        mark = label[p]
        for j in jumps:
            q = p + j
            if not ok[q]:
                continue
            other = label[q]
            if other == -2:
                label[q] = mark
                if level[q] < e:
                    level[q] = e
                heapq.heappush(heap, (level[q], q))
            elif other != mark:
                key, w = (mark, other) if mark < other else (other, mark), e if e > level[q] else level[q]
                if w < spills.get(key, math.inf):
                    spills[key] = w
    return np.array(label)[at[own]], np.array(level)[at[own]], spills


def _solve_spills(edges: list[tuple[int, int, float]]) -> dict[int, float]:
    """Least level at which each label spills to the ocean."""
    beside: dict[int, list[tuple[int, float]]] = {}
    for u, v, w in edges:
        beside.setdefault(u, []).append((v, w))
        beside.setdefault(v, []).append((u, w))
    level, heap = {}, [(-math.inf, OCEAN)]
    while heap:
        e, u = heapq.heappop(heap)
        if u in level:
            continue
        level[u] = e
        for v, w in beside.get(u, ()):
            if v not in level:
                heapq.heappush(heap, (max(e, w), v))
    return level


def _least(edges: DataFrame) -> DataFrame:
    """The least spill of each pair."""
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.min("w").alias("w"))


def spill_levels(edges: DataFrame, small: int = SPILLS) -> DataFrame:
    """(label, level): from spills (u, v, w) between labels, the least level at which water from each gets to the ocean.

    While there are more than ``small`` spills, each label pours over its lowest spill:
    labels that pour into one another become one, and a label's level is at least the
    highest spill on its way there. Labels halve in each round, and ways within a round
    are halved too. The small rest is solved with a heap.
    """
    edges = cut(_least(edges))
    own = edges.select(F.col("u").alias("label")).union(edges.select("v")).distinct().where(F.col("label") != OCEAN)
    labels = cut(own.select("label", F.col("label").alias("at"), F.lit(float("-inf")).alias("level")))
    while edges.count() > small:
        both = edges.select("u", "v", "w").union(edges.select("v", "u", "w"))
        low = F.struct("w", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))  # one order of all spills, so ways have no loops but pairs
        pour = both.where(F.col("u") != OCEAN).groupBy("u").agg(F.min_by("v", low).alias("to"), F.min("w").alias("w"))
        back = pour.select(F.col("u").alias("_u"), F.col("to").alias("_back"))
        pair = pour.join(back, F.col("to") == F.col("_u"), "left").withColumn("root", F.coalesce((F.col("_back") == F.col("u")) & (F.col("u") < F.col("to")), F.lit(False)))
        way = cut(pair.select("u", F.when(~F.col("root"), F.col("to")).alias("to"), F.when(~F.col("root"), F.col("w")).otherwise(F.lit(float("-inf"))).alias("w")))
        while True:  # halve ways until all end in a root or the ocean
            on = way.where("to is not null").select(F.col("u").alias("_u"), F.col("to").alias("_to"), F.col("w").alias("_w"))
            further = cut(way.join(on, F.col("to") == F.col("_u"), "left").select("u", F.coalesce("_to", "to").alias("to"), F.greatest("w", F.coalesce("_w", F.lit(float("-inf")))).alias("w"), F.col("_to").isNotNull().alias("moved")))
            drop_cut(way)
            way = further
            if way.where("moved").isEmpty():
                break
        to = way.where("to is not null").select(F.col("u").alias("_u"), F.col("to").alias("_to"), F.col("w").alias("_w"))
        after = cut(labels.join(to, F.col("at") == F.col("_u"), "left").select("label", F.coalesce("_to", "at").alias("at"), F.greatest("level", F.coalesce("_w", F.lit(float("-inf")))).alias("level")))
        ends = edges
        for name in ("u", "v"):
            ends = ends.join(to.select(F.col("_u").alias(f"_{name}"), F.col("_to").alias(f"_{name}_to")), F.col(name) == F.col(f"_{name}"), "left").withColumn(name, F.coalesce(f"_{name}_to", name)).drop(f"_{name}", f"_{name}_to")
        merged = cut(_least(ends))
        for old in (labels, edges, way):
            drop_cut(old)
        labels, edges = after, merged
    rest = [(u, v, w) for u, v, w in edges.collect()]  # at most ``small``
    if not rest:
        return labels.select("label", "level")
    solved = labels.sparkSession.createDataFrame([(u, w) for u, w in _solve_spills(rest).items() if u != OCEAN], "at long, _rest double")
    return labels.join(solved, "at", "left").select("label", F.greatest("level", F.coalesce("_rest", F.lit(float("-inf")))).alias("level"))


def filled_surface(cells: DataFrame, grid: Grid, tile_cells: int = TILE_CELLS, small: int = SPILLS) -> DataFrame:
    """(cell_id, z, filled): the lowest surface from which water leaves every cell.

    One pass floods the tiles, on cells and a border of cells from the tiles beside them.
    Spills between labels of one tile, and over its border into the next, make a graph of
    border size; its levels raise the cells of their labels.
    """
    tiled = with_halo(cells.select("cell_id", "z"), grid, tile_cells).withColumn("border", on_border(grid, F.col("cell_id"), tile_cells))
    cols = grid.cols

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.own.to_numpy()
        if not own.any():
            return pd.DataFrame({k: [] for k in ("cell_id", "z", "label", "level", "other")})
        label, level, spills = _flood_tile(pdf.cell_id.to_numpy(), pdf.z.to_numpy(), own, pdf.border.to_numpy(), cols)
        out = pd.DataFrame({"cell_id": pdf.cell_id[own].to_numpy(), "z": pdf.z[own].to_numpy(), "label": label, "level": level, "other": pd.array([None] * len(label), "Int64")})
        if not spills:
            return out
        pairs = np.array(list(spills))
        return pd.concat([out, pd.DataFrame({"cell_id": -1, "z": np.nan, "label": pairs[:, 0], "level": list(spills.values()), "other": pd.array(pairs[:, 1], "Int64")})])

    got = tiled.groupBy("tile").applyInPandas(run, "cell_id long, z double, label long, level double, other long")
    if one_tile(grid, tile_cells):
        return got.where("other is null").select("cell_id", "z", F.col("level").alias("filled"))
    got = cut(got)
    inside = got.where("other is not null").select(F.col("label").alias("u"), F.col("other").alias("v"), F.col("level").alias("w"))
    border = got.where("other is null").where(on_border(grid, F.col("cell_id"), tile_cells)).select("cell_id", "label", "level")
    across = to_neighbours(border.select("cell_id", F.struct("label", "level").alias("z")), grid).where(F.col("target") > F.col("cell_id"))
    met = across.join(border.withColumnRenamed("cell_id", "target"), "target")
    beside = met.select(F.col("z.label").alias("u"), F.col("label").alias("v"), F.greatest("z.level", "level").alias("w"))
    levels = spill_levels(inside.unionByName(beside), small).withColumnRenamed("level", "_least")
    state = got.where("other is null")
    raised = state.where(F.col("label") != OCEAN).join(levels, "label", "left").select("cell_id", "z", F.greatest("level", F.coalesce("_least", F.lit(float("-inf")))).alias("filled"))
    return state.where(F.col("label") == OCEAN).select("cell_id", "z", F.col("level").alias("filled")).unionByName(raised)
