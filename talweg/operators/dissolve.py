"""Outlines of groups of cells.

Every cell gives its four sides; a side that two cells of a group share drops out in an
aggregate. The sides that are left form rings. Each side knows the next one by a join on
their corner; a tile's sides are put together to strands in a task, and the strands of a
ring are numbered by halving, so the longest outline is dealt over as many tasks as tiles.
A hole belongs to the ring that its row meets next to the left, itself a hole or not.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.lineage import cut, drop_cut
from talweg.sources.grid import Grid

TILE = 512  # corners on a tile's side

Point = tuple[float, float]


def boundary_edges(groups: DataFrame, grid: Grid) -> DataFrame:
    """(group_id, a, b): directed sides of the outline between grid corners (corner = row * (cols + 1) + column), with the group on the left in map view."""
    w = grid.cols + 1
    r, c = F.floor(F.col("cell_id") / grid.cols), F.pmod("cell_id", F.lit(grid.cols))
    nw = r * w + c
    ne, sw, se = nw + 1, nw + w, nw + w + 1
    sides = [(sw, se), (se, ne), (ne, nw), (nw, sw)]
    spread = groups.select("group_id", F.explode(F.array(*(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")) for a, b in sides))).alias("e"))
    keyed = spread.select("group_id", F.least("e.a", "e.b").alias("lo"), F.greatest("e.a", "e.b").alias("hi"), (F.col("e.a") < F.col("e.b")).alias("up"))
    left = keyed.groupBy("group_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.first("up").alias("up")).where("n = 1")
    return left.select("group_id", F.when(F.col("up"), F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("up"), F.col("hi")).otherwise(F.col("lo")).alias("b"))


def _direction(step: Column, w: int) -> Column:
    return F.when(step == 1, 0).when(step == -w, 1).when(step == -1, 2).otherwise(3).cast("long")


def linked_sides(groups: DataFrame, grid: Grid) -> DataFrame:
    """(group_id, side, next, a, b, turn): the outline's sides, the one that follows each, and whether the ring turns between them.

    Where cells of a group meet only at a corner the ring turns left, so that rings touch there instead of crossing.
    """
    w = grid.cols + 1
    sides = cut(boundary_edges(groups, grid))
    step = F.col("b") - F.col("a")
    left = F.when(step == 1, -w).when(step == -w, -1).when(step == -1, w).otherwise(1)  # the step after a left turn, rows counting down the map
    begin = sides.select("group_id", F.col("a").alias("_a"), F.col("b").alias("_b"), F.count(F.lit(1)).over(Window.partitionBy("group_id", "a")).alias("_n")).withColumnRenamed("group_id", "_g")
    met = sides.join(begin, (F.col("group_id") == F.col("_g")) & (F.col("b") == F.col("_a"))).where((F.col("_n") == 1) | (F.col("_b") == F.col("b") + left))
    after = F.col("_b") - F.col("_a")
    return met.select("group_id", (F.col("a") * 4 + _direction(step, w)).alias("side"), (F.col("b") * 4 + _direction(after, w)).alias("next"), "a", "b", (after != step).alias("turn"))


def _strands(group: np.ndarray, side: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a tile's sides: the first side of the strand of each, its place in it, and whether it is the last. A ring inside the tile begins at its least side."""
    _, code = np.unique(group, return_inverse=True)
    most = int(max(side.max(), nxt.max())) + 1
    key = code * most + side
    order = np.argsort(key)
    want = code * most + nxt
    at = np.minimum(np.searchsorted(key[order], want), len(key) - 1)
    to = np.where(key[order][at] == want, order[at], -1)
    n = len(key)
    far = to.copy()
    for _ in range(max(1, math.ceil(math.log2(n)) + 1)):  # what never leaves is a ring
        far = np.where(far >= 0, far[np.maximum(far, 0)], -1)
    ring = far >= 0
    if ring.any():
        low, jump = np.where(ring, key, key.max() + 1), np.where(ring, to, np.arange(n))
        for _ in range(max(1, math.ceil(math.log2(n)) + 1)):
            low, jump = np.minimum(low, low[jump]), jump[jump]
        to = np.where(ring & (key[np.maximum(to, 0)] == low), -1, to)
    before = np.full(n, -1)
    before[to[to >= 0]] = np.flatnonzero(to >= 0)
    head, place, up = np.arange(n), (before >= 0).astype(np.int64), before.copy()
    head = np.where(before >= 0, before, head)
    while (live := up >= 0).any():
        place = place + np.where(live, place[np.maximum(up, 0)], 0)
        head = head[head]
        up = np.where(live, up[np.maximum(up, 0)], -1)
    return side[head], place, to < 0


def ranked_sides(groups: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """(group_id, ring, place, a, b, turn): the sides of each ring in order; ring is the least first side of its strands."""
    w = grid.cols + 1
    linked = linked_sides(groups, grid)
    across = -(-w // tile)
    tiled = linked.withColumn("tile", (F.floor(F.floor(F.col("a") / w) / tile) * across + F.floor(F.pmod("a", F.lit(w)) / tile)).cast("long"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        head, place, last = _strands(pdf.group_id.to_numpy(), pdf.side.to_numpy(), pdf.next.to_numpy())
        return pdf[["group_id", "next", "a", "b", "turn"]].assign(head=head, place=place, last=last)

    inside = cut(tiled.groupBy("tile").applyInPandas(local, "group_id long, next long, a long, b long, turn boolean, head long, place long, last boolean"))
    strands = inside.where("last").select("group_id", "head", F.col("next").alias("to"), (F.col("place") + 1).alias("n"))
    if w <= tile and grid.rows + 1 <= tile:  # all rings lie inside the tile
        return inside.select("group_id", F.col("head").alias("ring"), "place", "a", "b", "turn")
    strands = cut(strands)
    state = cut(strands.select("group_id", "head", "to", F.col("head").alias("low"), F.lit(True).alias("moved")))
    while not state.where("moved").isEmpty():  # once no minimum falls any more, each has seen its whole ring
        far = state.select(F.col("group_id").alias("_g"), F.col("head").alias("_h"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        further = cut(state.join(far, (F.col("group_id") == F.col("_g")) & (F.col("to") == F.col("_h"))).select("group_id", "head", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved")))
        drop_cut(state)
        state = further
    ring = state.select("group_id", "head", F.col("low").alias("ring"))
    sums = cut(strands.join(ring, ["group_id", "head"]).select("group_id", "head", "ring", F.when(F.col("to") != F.col("ring"), F.col("to")).alias("to"), "n"))
    while not sums.where("to is not null").isEmpty():
        far = sums.select(F.col("group_id").alias("_g"), F.col("head").alias("_h"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        further = cut(sums.join(far, (F.col("group_id") == F.col("_g")) & (F.col("to") == F.col("_h")), "left").select("group_id", "head", "ring", F.col("_to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")))
        drop_cut(sums)
        sums = further
    whole = sums.where("head = ring").select("group_id", "ring", F.col("n").alias("_all"))
    first = sums.join(whole, ["group_id", "ring"]).select("group_id", "head", "ring", (F.col("_all") - F.col("n")).alias("first"))
    return inside.join(first, ["group_id", "head"]).select("group_id", "ring", (F.col("first") + F.col("place")).alias("place"), "a", "b", "turn")


def ring_parts(sides: DataFrame, grid: Grid) -> DataFrame:
    """(group_id, ring, part, area): each ring of ranked sides, the outer ring that it belongs to, and its area, below 0 for holes."""
    w = grid.cols + 1
    row, col = lambda c: F.floor(F.col(c) / w).cast("long"), lambda c: F.pmod(c, F.lit(w)).cast("long")
    doubled = F.sum(col("a") * row("b") - col("b") * row("a"))  # in cells; rows count down the map
    rings = cut(sides.groupBy("group_id", "ring").agg((-doubled).alias("doubled")))
    upright = sides.where(F.abs(F.col("a") - F.col("b")) == w).select("group_id", "ring", F.floor(F.least("a", "b") / w).alias("r"), col("a").alias("c"))
    beside = upright.withColumn("to", F.lag("ring").over(Window.partitionBy("group_id", "r").orderBy("c")))
    # left of a hole's leftmost side is the group, as far as the next side of a ring
    home = beside.groupBy("group_id", "ring").agg(F.min_by("to", F.struct("c", "r")).alias("to"))
    state = cut(rings.join(home, ["group_id", "ring"]).select("group_id", "ring", F.when(F.col("doubled") < 0, F.col("to")).alias("to"), F.col("ring").alias("part")))
    while not state.where("to is not null").isEmpty():
        far = state.select(F.col("group_id").alias("_g"), F.col("ring").alias("_r"), F.col("to").alias("_to"), F.col("part").alias("_part"))
        further = cut(state.join(far, (F.col("group_id") == F.col("_g")) & (F.col("to") == F.col("_r")), "left").select("group_id", "ring", F.col("_to").alias("to"), F.coalesce("_part", "part").alias("part")))
        drop_cut(state)
        state = further
    return rings.join(state.select("group_id", "ring", "part"), ["group_id", "ring"]).select("group_id", "ring", "part", (F.col("doubled") / 2 * F.lit(grid.cell_area)).alias("area"))


def outline_points(groups: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """(group_id, part, ring, hole, place, x, y): the corners of each group's outline, without those inside straight runs, outer rings anticlockwise on the map."""
    w = grid.cols + 1
    sides = cut(ranked_sides(groups, grid, tile))
    parts = ring_parts(sides, grid).select("group_id", "ring", "part", (F.col("area") < 0).alias("hole"))
    x = F.lit(float(grid.x0)) + F.pmod("b", F.lit(w)) * F.lit(float(grid.dx))
    y = F.lit(float(grid.y0)) + F.floor(F.col("b") / w) * F.lit(float(grid.dy))
    place = -F.col("place") if (grid.dx > 0) == (grid.dy > 0) else F.col("place")  # rows then run the other way round
    return sides.where("turn").join(parts, ["group_id", "ring"]).select("group_id", "part", "ring", "hole", place.alias("place"), x.alias("x"), y.alias("y"))


def ring_area(ring: list[Point]) -> float:
    """Signed area; above 0 anticlockwise."""
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1])) / 2


def multipolygon_wkb(parts: list[list[list[Point]]]) -> bytes:
    out = [struct.pack("<BII", 1, 6, len(parts))]
    for rings in parts:
        out.append(struct.pack("<BII", 1, 3, len(rings)))
        for ring in rings:
            out += [struct.pack("<I", len(ring) + 1), np.array([*ring, ring[0]], "<f8").tobytes()]
    return b"".join(out)


def read_multipolygon(wkb: bytes) -> list[list[list[Point]]]:
    at, parts = 9, []
    for _ in range(struct.unpack_from("<I", wkb, 5)[0]):
        n, at = struct.unpack_from("<I", wkb, at + 5)[0], at + 9
        rings = []
        for _ in range(n):
            k, at = struct.unpack_from("<I", wkb, at)[0], at + 4
            rings.append([struct.unpack_from("<dd", wkb, at + 16 * i) for i in range(k - 1)])
            at += 16 * k
        parts.append(rings)
    return parts


def line_wkb(points: list[Point]) -> bytes:
    return struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


def dissolve(groups: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """(group_id, wkb, area): the outline of each group of cells (group_id, cell_id) as a MultiPolygon.

    One value holds a whole outline, as the format wants; outline_points() gives the same in rows.
    """

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "hole", "ring", "place"], kind="stable")
        parts: list[list[list[Point]]] = []
        for _, part in pdf.groupby("part", sort=False):
            parts.append([list(zip(ring.x.tolist(), ring.y.tolist())) for _, ring in part.groupby("ring", sort=False)])
        return pd.DataFrame({"group_id": [pdf.group_id.iloc[0]], "wkb": [multipolygon_wkb(parts)], "area": [sum(ring_area(r) for p in parts for r in p)]})

    return outline_points(groups, grid, tile).groupBy("group_id").applyInPandas(assemble, "group_id long, wkb binary, area double")
