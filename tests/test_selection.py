"""Selections and lowest neighbours in single passes over tiles."""

import numpy as np

import scalar
from talweg.operators import catchments, routing, trees
from talweg.sources.grid import Grid

ROWS, COLS = 23, 26
GRID = Grid(ROWS, COLS)


def surface(spark):
    rnd = np.random.default_rng(4)
    z = {i: float(v) for i, v in enumerate((np.add.outer(np.arange(ROWS) * 3.0, np.abs(np.arange(COLS) - 9.0)) + rnd.random((ROWS, COLS)) * 4).ravel())}
    down, _, _ = scalar.flood(z, ROWS, COLS)
    return z, down, spark.createDataFrame([(i, int(down[i])) for i in z], "cell_id long, down_id long")


def test_last_stops_on_small_blocks(spark):
    z, down, tree = surface(spark)
    for marks in (range(0, ROWS * COLS, 7), [], range(ROWS * COLS)):
        want, held = {}, set(marks)
        for i in z:
            p, want[i] = i, None
            while p >= 0:
                want[i], p = p if p in held else want[i], down[p]
        marked = spark.createDataFrame([(i,) for i in [*held, 10**6]], "cell_id long")  # one is no cell of the tree
        for tile in (16, 64, 1 << 18):
            assert {r.cell_id: r.stop for r in trees.last_stop(tree, marked, GRID, tile).collect()} == want


def test_lowest_neighbours_on_small_blocks(spark):
    rnd = np.random.default_rng(5)
    z = {i: float(rnd.integers(0, 5)) for i in range(ROWS * COLS) if rnd.random() > 0.2}
    z[0], z[ROWS * COLS - 1] = 1.0, 2.0
    cells = spark.createDataFrame(sorted(z.items()), "cell_id long, z double")
    for tile in (1, 16, 1 << 18):
        got = {r.cell_id: tuple(r)[1:] for r in routing.with_best_neighbour(cells, GRID, tile).collect()}
        assert set(got) == set(z)
        for i in z:
            near = sorted((z[n], n) for n in scalar.nbrs(i, ROWS, COLS) if n in z)
            best = near[0] if near else (None, None)
            assert got[i] == (z[i], len(near), best[1], best[0], sum(v == best[0] for v, _ in near) if near else None)


def test_cells_are_not_multiplied_or_searched_twice(spark):
    z, _, tree = surface(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    groups = plan(catchments.normalise_selection(tree, GRID, [5, 50, 300]))
    assert groups.count("FlatMapCoGroups") == 1 and "FlatMapGroups" not in groups
    cells = spark.createDataFrame(sorted(z.items()), "cell_id long, z double")
    assert "Generate" not in plan(routing.receivers_by_lowest(cells, GRID, check=False))


def test_inflows_meet_cells_in_their_tile(spark):
    """Sums over small blocks shuffle the cells by tile, not by cell as well."""
    z, down, tree = surface(spark)
    out = trees.upstream_sums(tree.selectExpr("cell_id", "down_id", "cell_id w"), GRID, 64)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    want = dict.fromkeys(z, 0)
    for i in z:
        p = i
        while p >= 0:
            want[p] += i
            p = down[p]
    assert {r.cell_id: r.total for r in out.collect()} == want
