"""Ways between outlets, followed over small tiles, against steps one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import scalar
from talweg.operators import network
from talweg.sources.grid import Grid


@pytest.fixture(scope="module")
def basin(spark):
    rows, cols = 24, 21
    rnd = np.random.default_rng(8)
    z = {i: float(v) for i, v in enumerate((np.add.outer(np.arange(rows) * 2.0, np.abs(np.arange(cols) - 10.0)) + rnd.random((rows, cols)) * 3).ravel())}
    down = scalar.flood(z, rows, cols)[0]
    outlets = {i for i in z if i % 37 == 3} | {i for i in z if down[i] < 0}
    owner = {}
    for i in z:
        p = i
        while p not in outlets:
            p = down[p]
        owner[i] = p
    left_out = {i for i, o in owner.items() if o == min(outlets, key=lambda o: (sum(v == o for v in owner.values()), o))}
    owner = {i: o for i, o in owner.items() if i not in left_out}
    return Grid(rows, cols), down, owner


@pytest.mark.parametrize("tile, model", [(9, None), (64, None), (1 << 18, None), (16, "some"), (16, "outlet")])
def test_ways(spark, basin, tile, model):
    grid, down, owner = basin
    outlets = set(owner.values())
    inside = sorted(i for i in owner if i not in outlets)
    m = {None: None, "some": max(inside, key=lambda i: sum(1 for j in outlets if j in owner and i in _way(j, down))), "outlet": max(outlets)}[model]
    assigned = spark.createDataFrame(list(owner.items()), "cell_id long, outlet_id long").repartition(3)
    tree = spark.createDataFrame([(i, int(d)) for i, d in down.items()], "cell_id long, down_id long")
    want = {}
    for o in outlets:
        way, at = [o], down[o]
        if o == m:
            want[o] = (None, way)
            continue
        if at < 0 or at not in owner:
            want[o] = (None, way + ([at] if at >= 0 else []))
            continue
        goal = owner[at]
        way.append(at)
        while at not in (m, goal):
            at = down[at]
            way.append(at)
        want[o] = (None if at == m else goal, way)
    got = {r.outlet_id: (r.ds_id, r.cells) for r in network.outlet_paths(assigned, tree, grid, m, tile).collect()}
    assert got == want and max(len(w) for _, w in want.values()) > 5
    assert tile > 9 or len({(c // grid.cols // 3, c % grid.cols // 3) for _, w in want.values() for c in w}) > 20


def _way(o, down):
    out, at = set(), down[o]
    while at >= 0:
        out.add(at)
        at = down[at]
    return out


def test_no_outlets(spark, basin):
    none = spark.createDataFrame([], "cell_id long, outlet_id long")
    tree = spark.createDataFrame([(1, -1)], "cell_id long, down_id long")
    assert network.outlet_paths(none, tree, basin[0]).withColumn("n", F.size("cells")).count() == 0
