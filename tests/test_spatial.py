"""Spatial joins against all pairs."""

import math
import random

import pytest

from talweg.operators import spatial
from talweg.sources.grid import Grid

ROWS, COLS = 37, 53
GRID = Grid(ROWS, COLS, 500.0, 2.0, 0.0, 90.0, 0.0, -3.0)


def centre(i):
    return 500.0 + 2.0 * (i % COLS + 0.5), 90.0 - 3.0 * (i // COLS + 0.5)


@pytest.fixture(scope="module")
def segments():
    rnd = random.Random(2)
    out = {}
    for i in rnd.sample(range(ROWS * COLS), 500):
        r, c = divmod(i, COLS)
        near = [(r + dr) * COLS + c + dc for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr or dc) and 0 <= r + dr < ROWS and 0 <= c + dc < COLS]
        out[i] = rnd.choice(near)
    return out


@pytest.fixture(scope="module")
def paths(spark, segments):
    return spark.createDataFrame([(i, d, i % 17 + 1) for i, d in segments.items()], "cell_id long, down_id long, acc_cells long").repartition(3)


def side(p, q, r):
    v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (v > 0) - (v < 0)


def meet(a, b, c, d):
    if any(max(a[k], b[k]) < min(c[k], d[k]) or max(c[k], d[k]) < min(a[k], b[k]) for k in (0, 1)):
        return False
    return side(c, d, a) * side(c, d, b) <= 0 and side(a, b, c) * side(a, b, d) <= 0


def distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


@pytest.mark.parametrize("bucket", [1, 5, 64])
def test_lines_against_all_pairs(spark, paths, segments, bucket):
    rnd = random.Random(bucket)
    at = lambda: (rnd.uniform(480, 625), rnd.uniform(-40, 110))
    snapped = lambda: centre(rnd.randrange(ROWS * COLS))
    lines = {k: [at() for _ in range(rnd.randint(0, 4))] for k in range(40)}
    lines |= {100 + k: [snapped() for _ in range(3)] for k in range(20)}
    lines |= {200: [(510.0, 200.0), (510.0, -200.0)], 201: [(0.0, 60.0), (900.0, 60.0)], 202: [(500.0 + 2 * 5, 90.0), (500.0 + 2 * 5, -21.0)], 203: [(500.0, 90.0 - 3 * 5), (606.0, 90.0 - 3 * 5)], 204: [centre(60), centre(60)], 205: [(-1e6, -1e6), (1e6, 1e6)]}
    rows = [(k, [tuple(map(float, p)) for p in line]) for k, line in lines.items()] + [(300, None), (301, []), (302, [(510.0, None), (520.0, 30.0)]), (303, [(float("nan"), 3.0), (520.0, 30.0)]), (200, [(590.0, 80.0), (590.0, 0.0)])]
    df = spark.createDataFrame(rows, "line_id long, points array<struct<x:double,y:double>>").repartition(3)
    lines[200] = lines[200] + [None, (590.0, 80.0), (590.0, 0.0)]
    want = {(k, i) for k, line in lines.items() for p, q in zip(line, line[1:]) if p and q for i, d in segments.items() if meet(centre(i), centre(d), p, q)}
    got = [tuple(r) for r in spatial.lines_crossing(paths, GRID, df, bucket).collect()]
    assert len(got) == len(set(got)) and {(k, i) for k, i, _ in got} == want and all(a == i % 17 + 1 for _, i, a in got)
    top = {r.line_id: (r.n_crossed, r.cell_id) for r in spatial.outlets_of_lines(spatial.lines_crossing(paths, GRID, df, bucket)).collect()}
    assert top == {k: (len(x), max(x, key=lambda i: (i % 17, i))) for k in {k for k, _ in want} if (x := [i for j, i in want if j == k])}


@pytest.mark.parametrize("k, bucket, most", [(1, 2, None), (4, 3, None), (3, 8, 7.5), (1000, 16, None)])
def test_nearest_against_all_pairs(spark, paths, segments, k, bucket, most):
    rnd = random.Random(k)
    points = [(n, rnd.uniform(450, 660), rnd.uniform(-80, 150)) for n in range(40)] + [(100 + n, *centre(rnd.randrange(ROWS * COLS))) for n in range(10)]
    points += [points[0], (0, 505.0, 20.0), (200, 1e7, -1e7), (None, 530.0, 40.0)]
    bad = [(300, None, 1.0), (301, float("nan"), 1.0), (302, float("inf"), 1.0)]
    df = spark.createDataFrame(points + bad, "point_id long, x double, y double").repartition(3)
    want = []
    for n, x, y in points:
        near = sorted((distance((x, y), centre(i), centre(d)), i) for i, d in segments.items())[:k]
        want += [(n, rank, d) for rank, (d, _) in enumerate(near, 1) if most is None or d <= most]
    got = [(r.point_id, r.rank, r.distance) for r in spatial.nearest_segments(paths, GRID, df, k, most, bucket).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-9)


def test_nothing_near_and_no_plan_of_all_pairs(spark, paths):
    none = spark.createDataFrame([], "point_id long, x double, y double")
    assert spatial.nearest_segments(paths, GRID, none).count() == 0
    one = spark.createDataFrame([(1, 520.0, 30.0)], "point_id long, x double, y double")
    assert spatial.nearest_segments(paths.where("false"), GRID, one).count() == 0
    lines = spark.createDataFrame([(1, [(510.0, 20.0), (550.0, 60.0)])], "line_id long, points array<struct<x:double,y:double>>")
    plan = spatial.lines_crossing(paths, GRID, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
