"""Outlines by ranked sides, against rings walked one by one."""

import random

import pytest

from talweg.operators import dissolve
from talweg.sources.grid import Grid


def walked(cells, cols):
    """Rings of corners of one group, in plain Python: sets of rings, each a cycle from its least corner on."""
    w = cols + 1
    sides = set()
    for i in cells:
        nw = i // cols * w + i % cols
        for a, b in ((nw + w, nw + w + 1), (nw + w + 1, nw + 1), (nw + 1, nw), (nw, nw + w)):
            sides ^= {(b, a)} if (b, a) in sides else {(a, b)}
    left = {1: -w, -w: -1, -1: w, w: 1}
    out = {}
    for a, b in sides:
        out.setdefault(a, set()).add(b)
    rings = set()
    while sides:
        a, b = min(sides)
        ring = []
        while (a, b) in sides:
            sides.discard((a, b))
            ring.append((a, b))
            c = b + left[b - a] if b + left[b - a] in out[b] else min(out[b])
            a, b = b, c
        corners = [b for (a, b), (_, d) in zip(ring, ring[1:] + ring[:1]) if d - b != b - a]
        k = corners.index(min(corners))
        rings.add(tuple(corners[k:] + corners[:k]))
    return rings


def blob(rnd, rows, cols, share):
    return {i for i in range(rows * cols) if rnd.random() < share}


@pytest.fixture(scope="module")
def shapes():
    rnd = random.Random(6)
    rows, cols = 19, 23
    nested = {r * cols + c for r in range(rows) for c in range(cols) if max(abs(r - 9), abs(c - 11)) % 4 in (0, 1) and max(abs(r - 9), abs(c - 11)) < 10}
    return rows, cols, {1: blob(rnd, rows, cols, 0.5), 2: blob(rnd, rows, cols, 0.85), 3: nested, 4: {0}, 5: {0, cols + 1}, 6: set(range(rows * cols)), 7: set(range(rows * cols)) - {5 * cols + 5, 6 * cols + 6, 5 * cols + 9, 12 * cols + 5}}


@pytest.mark.parametrize("tile, dy", [(3, -2.0), (512, 2.0)])
def test_rings_parts_and_holes(spark, shapes, tile, dy):
    rows, cols, groups = shapes
    g = Grid(rows, cols, 10.0, 1.0, 0.0, 50.0, 0.0, dy)
    df = spark.createDataFrame([(k, i) for k, cells in groups.items() for i in cells], "group_id long, cell_id long").repartition(3)
    corner = lambda p: int(round((p.y - 50.0) / dy)) * (cols + 1) + int(round(p.x - 10.0))
    rings, part_of, holes = {}, {}, {}
    for p in dissolve.outline_points(df, g, tile).collect():
        rings.setdefault((p.group_id, p.ring), {})[p.place] = corner(p)
        part_of[p.group_id, p.ring], holes[p.group_id, p.ring] = p.part, p.hole
    for k, cells in groups.items():
        got = set()
        for (j, _), at in rings.items():
            if j == k:
                order = [at[n] for n in sorted(at, reverse=dy > 0)]
                low = order.index(min(order))
                got.add(tuple(order[low:] + order[:low]))
        assert got == walked(cells, cols)
    out = {r.group_id: r for r in dissolve.dissolve(df, g, tile).collect()}
    for k, cells in groups.items():
        parts = dissolve.read_multipolygon(bytes(out[k].wkb))
        assert out[k].area == 2.0 * len(cells)
        assert all(dissolve.ring_area(p[0]) > 0 and all(dissolve.ring_area(h) < 0 for h in p[1:]) for p in parts)
        # a part's area is that of the cells joined by sides
        left, sizes = set(cells), []
        while left:
            todo = [left.pop()]
            n = 0
            while todo:
                i = todo.pop()
                n += 1
                for j in (i - cols, i + cols, *([i - 1] if i % cols else []), *([i + 1] if i % cols < cols - 1 else [])):
                    if j in left:
                        left.discard(j)
                        todo.append(j)
            sizes.append(2.0 * n)
        assert sorted(sum(map(dissolve.ring_area, p)) for p in parts) == sorted(sizes)
    assert [len(p) for p in dissolve.read_multipolygon(bytes(out[3].wkb))] == [2, 2, 1] or sorted(len(p) for p in dissolve.read_multipolygon(bytes(out[3].wkb))) == [1, 2, 2]


def test_no_cells(spark):
    none = spark.createDataFrame([], "group_id long, cell_id long")
    assert dissolve.dissolve(none, Grid(3, 3)).count() == 0 and dissolve.outline_points(none, Grid(2000, 2000)).count() == 0
