import math
import random
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import scalar
from talweg.engine import Terrain
from talweg.operators import catchments, dissolve, masks, network, routing, streams, trees
from talweg.sinks import layers, models
from talweg.sources import catg
from talweg.sources.grid import Cancelled, Grid, RaftsError, RorbError, TerrainError, WbnmError, read_ascii_grid

# A 7 x 7 surface with one pit; ids are 7 * row + column.
ROWS7 = ["9999999", "9876789", "9765679", "9852589", "9754579", "9863689", "9991999"]
Z7 = {7 * r + c: float(z) for r, line in enumerate(ROWS7) for c, z in enumerate(line)}
G7 = Grid(7, 7, 0.0, 1.0, 0.0, 0.0, 0.0, -1.0)


def cells_of(spark, z, parts=3):
    return spark.createDataFrame([(int(i), float(v)) for i, v in z.items()], "cell_id long, z double").repartition(parts)


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def random_surface(rows, cols, seed, holes=0.08, levels=6):
    rnd = random.Random(seed)
    return {i: float(rnd.randint(0, levels)) for i in range(rows * cols) if rnd.random() > holes}


@pytest.fixture(scope="module")
def seven(spark):
    return Terrain(G7, cells_of(spark, Z7))


def test_golden_flood(seven):
    got = {r.cell_id: r for r in seven.flood.collect()}
    assert {i: r.filled for i, r in got.items()} == Z7 | {24: 4.0}
    inner = [[got[7 * r + c].down_id for c in range(1, 6)] for r in range(1, 6)]
    assert inner == [[16, 17, 17, 17, 18], [23, 24, 24, 24, 25], [30, 31, 31, 31, 32], [30, 38, 38, 38, 32], [30, 45, 45, 45, 32]]
    order = [i for i, _ in sorted(((i, r.pop_rank) for i, r in got.items()), key=lambda x: x[1])]
    assert order[:12] == [45, 38, 31, 24, 30, 32, 23, 25, 17, 37, 39, 16] and order[-3:] == [46, 47, 48]


def test_golden_tree_and_reaches(seven):
    acc = {r.cell_id: r.acc for r in seven.tree.collect()}
    assert [acc[i] for i in (10, 17, 24, 31, 38, 45)] == [1, 4, 9, 14, 23, 26]
    orders = {r.cell_id: r.strahler for r in seven.cell_strahler.collect()}
    assert {i for i, o in orders.items() if o > 1} == {17, 24, 30, 31, 32, 38, 45} and orders[38] == orders[45] == 3
    shown = {r.cell_id: r.strahler for r in seven.flow_paths(2).collect()}
    assert {i for i, o in shown.items() if o == 1} == {16, 17, 18, 23, 25, 30, 32} and {i for i, o in shown.items() if o == 2} == {24, 31, 38}
    got = [tuple(r) for r in seven.reaches(2).orderBy("reach_id").collect()]
    assert got[0] == (1, 16, 16, 1, 2, 2, 1, 1.41) and got[4] == (5, 17, 17, 1, 4, 4, 1, 1.0) and got[7] == (8, 24, 38, 3, 9, 23, 2, 3.0)
    again = [tuple(r) for r in seven.reaches(2, seven.flow_paths(2)).orderBy("reach_id").collect()]
    assert again == got
    line = {r.reach_id: [(p.x, p.y) for p in r.line] for r in streams.reach_lines(seven.flow_paths(2), G7, seven.reaches(2)).collect()}
    assert line[8] == [(3.5, -3.5), (3.5, -4.5), (3.5, -5.5), (3.5, -6.5)]


def test_golden_subcatchments(spark, seven):
    outlet = spark.createDataFrame([(38,)], "cell_id long")
    by = {}
    for r in seven.assignment(5, outlet).collect():
        by.setdefault(r.outlet_id, []).append(r.cell_id)
    assert {k: sorted(v) for k, v in by.items()} == {24: [8, 9, 10, 11, 12, 16, 17, 18, 24], 31: [15, 19, 23, 25, 31], 38: [22, 26, 29, 30, 32, 33, 36, 38, 40]}
    layer = seven.subcatchments(5.0, outlet, min_acc=2).collect()
    assert {(r.outlet_id, r.cell_count, r.area_m2, r.area_ha, r.strahler) for r in layer} == {(24, 9, 9.0, 0.0, 2), (31, 5, 5.0, 0.0, 2), (38, 9, 9.0, 0.0, 2)}
    sizes = sorted(r["count"] for r in seven.assignment(5).groupBy("outlet_id").count().collect())
    assert len(sizes) == 27 and sizes[-4:] == [3, 5, 9, 9] and sizes[:23] == [1] * 23


@pytest.mark.parametrize("seed", range(3))
def test_random_surfaces(spark, seed):
    rows, cols = 17 + 4 * seed, 11 + seed
    z, g = random_surface(rows, cols, seed), Grid(rows, cols, 100.0, 2.0, 0.0, 50.0, 0.0, -3.0)
    t = Terrain(g, cells_of(spark, z))
    down, filled, order = scalar.flood(z, rows, cols)
    acc = scalar.accumulate(down, order)
    assert {r.cell_id: (r.down_id, r.filled, r.pop_rank) for r in t.flood.collect()} == {i: (down[i], filled[i], k) for k, i in enumerate(order)}
    # tiles of three rows: paths, sums and levels cross many borders
    small = 3 * cols
    assert {r.cell_id: r.filled for r in routing.filled_surface(t.cells, g, small).collect()} == filled
    tiled = streams.accumulation(t.receivers, g, tile_cells=small)
    assert {r.cell_id: r.acc for r in tiled.collect()} == acc
    for band in (4, 64):
        got = streams.strahler(t.tree, g, band=band, tile_cells=small)
        assert {r.cell_id: r.strahler for r in got.collect()} == scalar.strahler(set(z), down, acc)
    shown = {i for i in z if down[i] >= 0 and acc[i] >= 3}
    orders = scalar.strahler(shown, down, acc)
    assert {r.cell_id: r.strahler for r in t.flow_paths(3).collect()} == orders
    length = lambda a, b: math.hypot(2.0 * (a % cols - b % cols), 3.0 * (a // cols - b // cols))
    got = [tuple(r)[1:] for r in t.reaches(3).orderBy("reach_id").collect()]
    assert got == scalar.reaches(shown, down, acc, orders, length)
    big = max(z, key=lambda i: (acc[i], i))
    other = min(i for i in z if acc[i] >= 3)
    stop = t.tree.withColumn("stop", F.col("cell_id").isin(big, other))
    firsts = {r.cell_id: r.stop for r in trees.first_stop(stop, g, small).collect()}
    for i in z:
        j = i
        while j >= 0 and j not in (big, other):
            j = down[j]
        assert firsts[i] == (j if j >= 0 else None)
    assert {r.cell_id for r in catchments.upstream(t.tree, g, [big]).collect()} == scalar.upstream(down, big)
    domain = scalar.upstream(down, big) | scalar.upstream(down, other)
    ds = spark.createDataFrame([(i,) for i in domain], "cell_id long")
    for m in (1, 4, 9):
        chosen, owner = scalar.greedy(domain, down, acc, m)
        got = catchments.greedy_outlets(t.tree, g, m, ds)
        assert {r.cell_id for r in got.collect()} == chosen
        assert {r.cell_id: r.outlet_id for r in catchments.assign(t.tree, g, got, ds).collect()} == owner


def test_lowest_receivers_refuse_pits(spark):
    with pytest.raises(TerrainError):
        routing.receivers_by_lowest(cells_of(spark, Z7), G7)
    slope = {i: 10.0 * (i // 9) + (i * 7919 % 101) / 50.0 for i in range(90)}
    g = Grid(10, 9)
    down, _, _ = scalar.flood(slope, 10, 9)
    assert {r.cell_id: r.down_id for r in routing.receivers_by_lowest(cells_of(spark, slope), g).collect()} == down


def test_several_dems_flood_apart(spark):
    cells = cells_of(spark, Z7).withColumn("dem_id", F.lit("a")).unionByName(cells_of(spark, {i: -z for i, z in Z7.items()}).withColumn("dem_id", F.lit("b")))
    got = routing.flood(cells, G7).where("dem_id = 'a'")
    assert {r.cell_id: r.down_id for r in got.collect()} == scalar.flood(Z7, 7, 7)[0]


def test_selection_and_groups(spark, seven):
    norm = pairs(catchments.normalise_selection(seven.tree, G7, [24, 38, 30, 16]), "group_id", "cell_id")
    assert {g for g, _ in norm} == {38} and len(norm) == 23
    groups = spark.createDataFrame([(24, 1), (24, 2), (31, 2), (31, 3), (38, 3), (38, 4), (38, 5), (16, 9)], "group_id long, cell_id long")
    assert pairs(catchments.merge_groups(groups, seven.tree), "group_id", "cell_id") == {(38, 1), (38, 2), (38, 3), (38, 4), (38, 5), (16, 9)}
    at = spark.createDataFrame([(3,)], "cell_id long")
    assert catchments.group_at(groups, at).first().group_id == 31
    s = catchments.selection_summary(groups, G7).first()
    assert (s.n_groups, s.n_cells, s.area_m2) == (4, 6, 6.0)


def test_points_and_lines(spark, seven):
    paths = seven.flow_paths(2)
    assert catchments.nearest_segment(paths, G7, 3.4, -4.1).first().cell_id == 24
    assert catchments.nearest_segment(paths, G7, 300.0, -4.1, max_distance=5.0).count() == 0
    crossed = catchments.crossing_order(catchments.line_crossing(paths, G7, [(1.0, -5.0), (6.0, -5.0)])).collect()
    assert crossed[0].cell_id == 31 and [r.acc_cells for r in crossed] == sorted((r.acc_cells for r in crossed), reverse=True)
    assert catchments.model_outlet(spark.createDataFrame([(7, 3), (9, 3)], "cell_id long, acc_cells long")).first().cell_id == 9
    assert catchments.cell_under(seven.cells, G7, 3.2, -1.9).first().cell_id == 10
    assert catchments.cell_under(seven.cells, G7, 30.2, -1.9).count() == 0
    with pytest.raises(TerrainError):
        catchments.line_crossing(paths, G7, [(0, 0)])
    assert catchments.line_middle([(0.0, 0.0), (0.0, 0.0), (2.0, 0.0), (2.0, 4.0)]) == (2.0, 1.0)
    assert streams.style(paths).count() == 2


def test_masks(spark, seven):
    ring = [(1.2, -1.2), (4.6, -1.2), (4.6, -3.7), (1.2, -3.7)]
    touched = {7 * r + c for r in range(1, 4) for c in range(1, 5)}
    holed = seven.all_cells.withColumn("z", F.when(F.col("cell_id") != 16, F.col("z")))
    assert {r.cell_id for r in masks.mask_filter(holed, G7, [ring]).collect()} == touched - {16}
    q = masks.mask_quality(holed, G7, [ring]).first()
    assert (q.has_mask, q.mask_cells, q.valid_cells, q.nodata_cells) == (True, 12, 11, 1)
    assert not masks.mask_quality(holed, G7, None).first().has_mask
    assert [r.cell_id for r in masks.nodata_cells(holed, G7).collect()] == [16]
    assert [c for c, _ in masks.validate(holed, G7, [ring])] == ["mask_nodata"] and [c for c, _ in masks.validate(holed, G7)] == ["nodata"]
    with pytest.raises(TerrainError):
        masks.validate(holed, G7, [[(50, 50), (60, 50), (60, 60)]])
    with pytest.raises(TerrainError):
        masks.closed([(0, 0), (1, 1)])
    # the mask's edge makes outlets
    t = Terrain(G7, holed, [ring])
    assert {r.cell_id: r.down_id for r in t.receivers.collect()} == scalar.flood({i: Z7[i] for i in touched - {16}}, 7, 7)[0]


def test_dissolve(spark):
    g = Grid(6, 6, 10.0, 2.0, 0.0, 40.0, 0.0, -2.0)
    ring = [0, 1, 2, 6, 8, 12, 13, 14]  # 3 x 3 with a hole
    touch = [21, 28]  # two cells that meet at a corner
    rows = [(1, i) for i in ring] + [(2, i) for i in touch]
    got = {r.group_id: r for r in dissolve.dissolve(spark.createDataFrame(rows, "group_id long, cell_id long"), g).collect()}
    assert got[1].area == 32.0 and got[2].area == 8.0
    one, two = (dissolve.read_multipolygon(bytes(got[k].wkb)) for k in (1, 2))
    assert len(one) == 1 and len(one[0]) == 2 and len(one[0][0]) == 4 and dissolve.ring_area(one[0][1]) == -4.0
    assert len(two) == 2 and all(dissolve.ring_area(p[0]) == 4.0 for p in two)
    rnd = random.Random(4)
    cells = [i for i in range(36) if rnd.random() < 0.6]
    r = dissolve.dissolve(spark.createDataFrame([(7, i) for i in cells], "group_id long, cell_id long"), g).first()
    assert r.area == 4.0 * len(cells) and sum(dissolve.ring_area(x) for p in dissolve.read_multipolygon(bytes(r.wkb)) for x in p) == r.area


@pytest.fixture(scope="module")
def model(spark, seven):
    return seven.assignment(5, spark.createDataFrame([(38,)], "cell_id long")).cache()


def test_network(spark, seven, model):
    links = network.downstream_map(model, seven.tree)
    assert pairs(links, "outlet_id", "ds_id") == {(24, 31), (31, 38), (38, None)}
    order = network.depth_order(links, seven.tree).orderBy("position").collect()
    assert [(r.outlet_id, r.depth) for r in order] == [(24, 2), (31, 1), (38, 0)]
    network.require_one_terminal(links)
    with pytest.raises(TerrainError):
        network.require_one_terminal(links.where("ds_id is not null"))
    with pytest.raises(TerrainError):
        network.with_depth(spark.createDataFrame([(1, 2), (2, 1)], "outlet_id long, ds_id long"))
    ways = {r.outlet_id: (r.ds_id, r.cells) for r in network.outlet_paths(model, seven.tree, G7).collect()}
    assert ways == {24: (31, [24, 31]), 31: (38, [31, 38]), 38: (None, [38, 45])}
    quirk = {r.outlet_id: (r.ds_id, r.cells) for r in network.outlet_paths(model, seven.tree, G7, 38).collect()}
    assert quirk == {24: (31, [24, 31]), 31: (None, [31, 38]), 38: (None, [38])}
    m = {r.outlet_id: r for r in network.path_measures(network.outlet_paths(model, seven.tree, G7), G7, (3.75, -6.75)).collect()}
    assert m[24].length_m == 1.0 and (m[24].mid_x, m[24].mid_y) == (3.5, -4.0) and m[38].length_m == pytest.approx(1 + math.hypot(0.25, 0.25))
    s = {r.node_id: (r.sx, r.sy) for r in network.display_scale(spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 2.0)], "node_id long, x double, y double")).collect()}
    assert s == {1: (2.5, 2.5), 2: (92.5, 92.5)}


def test_label_points(spark, seven, model):
    inside = {}
    for r in model.collect():
        inside.setdefault(r.outlet_id, set()).add(r.cell_id)
    for r in catchments.surface_points(model, G7).collect():
        at = {7 * math.floor(-r.y) + math.floor(r.x), 7 * math.floor(-r.y) + math.ceil(r.x) - 1}
        assert at & inside[r.outlet_id]


def test_wbnm_and_xprafts(tmp_path, seven, model):
    import datetime

    path, n, ha, segments = models.write_wbnm(model, seven.tree, G7, str(tmp_path / "a"), today=datetime.date(2024, 2, 3))
    text = open(path).read()
    assert path.endswith(".wbn") and (n, ha, segments) == (3, 0.002, 2) and text.endswith("|\n")
    lines = text.split("\n")
    assert sum(x.startswith("#####START_") and x.endswith("|") for x in lines) == 9 and "Last Edit    ! 03/02/2024" in lines
    at = next(i for i, x in enumerate(lines) if x.startswith("#####START_TOPOLOGY"))
    assert lines[at].index("|") == 35 and lines[at + 1] == f"{3:12d}      talweg"
    assert lines[at + 2][61:] == "S002" and lines[at + 4][61:] == "SINK" and len(lines[at + 2][:60]) == 60
    path, nodes, links, ha = models.write_xprafts(model, seven.tree, G7, str(tmp_path / "b.xpx"))
    raw = open(path, newline="").read()
    assert (nodes, links, ha) == (3, 2, 0.002) and raw.count("\r\n") == raw.count("\n")
    rows = raw.split("\r\n")
    assert sum(x.startswith("NODE 134") for x in rows) == 3 and 'LINK 136 "Link 1" "S001" "S002"' in rows
    assert sum('"S001" ' in x and x.startswith("DATA") for x in rows) == 14 * 5 + 48 + 1 and sum('"Link 1" 0' in x for x in rows if x.startswith("DATA")) == 23
    assert 'DATA DT "" 0 10 ' + " ".join(["1.000000"] * 10) in rows


def test_rorb_round_trip(spark, tmp_path, seven, model):
    path, basins, reaches = models.write_rorb(model, seven.tree, G7, str(tmp_path / "x" / "m"), impervious=0.25)
    assert (basins, reaches) == (3, 3) and path.endswith(".catg")
    text = open(path).read()
    assert "7.2" in text and text.split("C END RORB_GE")[1].split("\n")[2:6] == ["1", "1,    0.001,  -99", "2,    0.001,  -99", "2,    0.002,  -99"]
    nodes, links = catg.read_catg(spark, path)
    assert pairs(nodes, "node_id", "downstream", "is_basin", "is_outlet") == {("1", "2", 1, 0), ("2", "3", 1, 0), ("3", "4", 1, 0), ("4", "0", 0, 1)}
    assert nodes.where("node_id = '4'").first().print_code == 72 and nodes.where("node_id = '2'").first().imperv_frac == 0.25
    assert pairs(links, "reach_id", "us_node", "ds_node") == {("1", "1", "2"), ("2", "2", "3"), ("3", "3", "4")}
    assert all(len(r.line) == 3 for r in links.collect())
    assert [c for c, _ in models.rorb_warnings(model)] == ["few_subcatchments", "outlet_inferred"]
    lines, order = models.routing_program({1: 3, 2: 3, 3: 5, 4: 5}, {k: 1.0 for k in range(1, 5)}, 5)
    assert order == [2, 1, 3, 4] and [x.split(",")[0] for x in lines[1:8]] == ["1", "3", "1", "4", "2", "3", "1"]
    deep = {k: k + 1 for k in range(1, 5000)}
    assert len(models.routing_program(deep, {k: 1.0 for k in deep}, 5000)[1]) == 4999
    for bad in ({1: 2, 2: 1}, {1: 7}):
        with pytest.raises(TerrainError):
            models.check_connected(bad, 3)


def test_catg_layouts(spark, tmp_path):
    text = """title
C #NODES
C      3
C 1 10 20 1 1 0 2 a 1.5 0.1 0 0 0
C junk line
C 2 30 40 1 0 1 0 out 0 0 72
C 1 11 21 1 1 0 <2> again
C #REACHES
C      3
C 1 named 1 2 0 1 0 2.5 0.1 1 0
C 15
C 25
C 2 1 2 0 3 0 4.5 0.2 1 0
C 16
C 26
C 9 1 8 0 3 0 4.5 0.2 1 0
C 16
C 26
C END RORB_GE
C 5 1 2 0 3 0 4.5 0.2 1 0
"""
    (tmp_path / "a.catg").write_text(text)
    nodes, links = catg.read_catg(spark, str(tmp_path))
    assert pairs(nodes, "node_id", "name", "downstream", "x") == {("1", "again", "2", 11.0), ("2", "out", "0", 30.0)}
    assert pairs(links, "reach_id", "name", "length_km", "reach_type") == {("1", "named", 2.5, 1), ("2", "", 4.5, 3)}
    assert [(p.x, p.y) for p in links.where("reach_id = '2'").first().line] == [(11.0, 21.0), (16.0, 26.0), (30.0, 40.0)]


def test_gpkg_and_shapefiles(spark, tmp_path, seven, model):
    path = str(tmp_path / "o.gpkg")
    shapes = dissolve.dissolve(model.withColumnRenamed("outlet_id", "group_id"), G7)
    layers.write_layers(streams.path_lines(seven.flow_paths(2), G7), shapes, path, "EPSG:32755")
    db = sqlite3.connect(path)
    assert db.execute("SELECT count(*), sum(acc_cells) FROM flow_paths").fetchone()[0] == seven.flow_paths(2).count()
    assert dict(db.execute("SELECT table_name, srs_id FROM gpkg_contents")) == {"flow_paths": 32755, "subcatchments": 32755}
    blob = db.execute("SELECT wkb FROM subcatchments WHERE group_id = 24").fetchone()[0]
    assert blob[:2] == b"GP" and sum(dissolve.ring_area(x) for p in dissolve.read_multipolygon(layers.from_gpkg_blob(blob)) for x in p) == 9.0
    db.close()
    back = layers.read_gpkg(spark, path, "flow_paths")
    assert pairs(back, "cell_id", "down_id", "length_m") == pairs(seven.flow_paths(2), "cell_id", "down_id", "length_m")
    with pytest.raises(TerrainError):
        layers.write_gpkg(shapes, path, "subcatchments", "wkb", overwrite_layer=False)
    folder, files, ha = layers.write_tuflow(model, G7, str(tmp_path / "t"))
    assert len(files) == 7 and ha == 0.002
    raw = open(files[0], "rb").read()
    assert struct.unpack(">i", raw[:4])[0] == 9994 and struct.unpack(">i", raw[24:28])[0] * 2 == len(raw) and struct.unpack("<i", raw[32:36])[0] == 5
    dbf = open(files[0].replace(".shp", ".dbf"), "rb").read()
    assert b"Rain_001" in dbf and struct.unpack("<I", dbf[4:8])[0] == 1 and b"1.00000" in dbf
    with pytest.raises(TerrainError):
        layers.write_tuflow(model, G7, str(tmp_path / "t"))


def test_catalog_and_tags(spark, seven):
    from talweg.functions.jobs import cancel, tagged
    from talweg.sources.grid import list_grids

    seven.all_cells.createOrReplaceTempView("some_dem")
    spark.range(1).createOrReplaceTempView("no_dem")
    assert "some_dem" in list_grids(spark) and "no_dem" not in list_grids(spark)
    with tagged(spark, "run-1"):
        assert "run-1" in spark.sparkContext.getJobTags() and spark.range(3).count() == 3
    assert "run-1" not in spark.sparkContext.getJobTags()
    cancel(spark, "run-1")


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 5\nyllcorner 7\ncellsize 2\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    g, cells = read_ascii_grid(spark, str(tmp_path / "g.asc") + "|layer")
    assert (g.rows, g.cols, g.x0, g.y0, g.dy, g.nodata) == (2, 3, 5.0, 11.0, -2.0, -9999.0)
    assert pairs(cells, "cell_id", "r", "c", "z") == {(0, 0, 0, 1.0), (1, 0, 1, 2.0), (2, 0, 2, 3.0), (3, 1, 0, 4.0), (4, 1, 1, -9999.0), (5, 1, 2, 6.0)}
    assert Terrain(g, cells).cells.count() == 5
    with pytest.raises(TerrainError):
        Grid(2, 2, rx=0.1)
    assert (g.min_cells(9), g.min_cells(0), g.min_cells(None)) == (3, 1, 1)


def lzw(data):
    """TIFF's LZW, written from the codes' definition: a table of words by code, one code for the longest known word."""
    bits, table, word = [], None, b""

    def put(code, width):
        bits.extend(int(x) for x in f"{code:0{width}b}")

    put(256, 9)
    table, width = {bytes([k]): k for k in range(256)}, 9
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = len(table) + 2
        if len(table) + 2 > 4093:
            put(256, width)
            table, width = {bytes([k]): k for k in range(256)}, 9
        elif len(table) + 2 >= 1 << width:
            width += 1
        word = data[k : k + 1]
    if word:
        put(table[word], width)
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    put(257, width)
    bits += [0] * (-len(bits) % 8)
    return bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))


def tiff(values, kind, packing=1, tile=0, predictor=1, big=False, bands=1):
    """A small GeoTIFF: origin (100, 50), cells of 2 by 3, nodata -9999, EPSG:28355; further bands hold zeros."""
    import zlib

    import zstandard

    pack = {1: bytes, 8: zlib.compress, 5: lzw, 50000: zstandard.ZstdCompressor().compress}[packing]
    v = np.asarray(values, dtype=kind)
    h, w = v.shape
    step = tile or 2
    parts = []
    for r in range(0, h, step):
        for c in range(0, w, tile or w):
            b = v[r : r + step, c : c + (tile or w)]
            if tile:
                b = np.pad(b, ((0, tile - b.shape[0]), (0, tile - b.shape[1])))
            b = np.stack([b] + [np.zeros_like(b)] * (bands - 1), 2)
            if predictor == 2:
                b = np.concatenate([b[:, :1], np.diff(b, axis=1)], 1)
            raw = np.ascontiguousarray(b).tobytes()
            if predictor == 3:
                n = v.itemsize
                planes = np.ascontiguousarray(b.astype(b.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(b), -1, n).transpose(0, 2, 1).reshape(len(b), -1, bands)
                raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], 1).astype(np.uint8).tobytes()
            parts.append(pack(raw))
    head = 16 if big else 8
    offsets, data = [], b""
    for x in parts:
        offsets.append(head + len(data))
        data += x
    form = {"u": 1, "i": 2, "f": 3}[np.dtype(kind).kind]
    entries = [(256, "I", [w]), (257, "I", [h]), (258, "H", [v.itemsize * 8] * bands), (259, "H", [packing]), (277, "H", [bands]), (317, "H", [predictor]), (339, "H", [form] * bands), (33550, "d", [2.0, 3.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 100.0, 50.0, 0.0]), (42113, "s", b"-9999\0"), (34735, "H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 28355])]
    place = "Q" if big else "I"
    entries += [(322, "I", [tile]), (323, "I", [tile]), (324, place, offsets), (325, place, [len(x) for x in parts])] if tile else [(273, place, offsets), (278, "I", [step]), (279, place, [len(x) for x in parts])]
    entries.sort()
    room, at = (8, 16 + len(data)) if big else (4, 8 + len(data))
    extra, out, base = b"", b"", at + (8 + 20 * len(entries) + 8 if big else 2 + 12 * len(entries) + 4)
    for tag, code, held in entries:
        body = held if code == "s" else struct.pack("<" + code * len(held), *held)
        out += struct.pack("<HH" + place, tag, {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}[code], len(held))
        if len(body) <= room:
            out += body.ljust(room, b"\0")
        else:
            out += struct.pack("<" + place, base + len(extra))
            extra += body
    if big:
        return struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) + data + struct.pack("<Q", len(entries)) + out + b"\0" * 8 + extra
    return struct.pack("<2sHI", b"II", 42, at) + data + struct.pack("<H", len(entries)) + out + b"\0" * 4 + extra


@pytest.mark.parametrize("kind,packing,tile,predictor,big,bands", [("<f4", 1, 0, 1, False, 1), ("<i2", 8, 0, 2, False, 2), ("<f8", 8, 4, 1, True, 1), ("<f4", 5, 0, 3, False, 1), ("<f8", 50000, 4, 3, True, 2)])
def test_geotiff(spark, tmp_path, kind, packing, tile, predictor, big, bands):
    from talweg.sources.geotiff import read_geotiff

    values = [[7 * r + c for c in range(7)] for r in range(5)]
    (tmp_path / "a.tif").write_bytes(tiff(values, kind, packing, tile, predictor, big, bands))
    g, cells = read_geotiff(spark, str(tmp_path / "a.tif"))
    assert (g.rows, g.cols, g.x0, g.dx, g.y0, g.dy, g.nodata, g.crs) == (5, 7, 100.0, 2.0, 50.0, -3.0, -9999.0, "EPSG:28355")
    assert {r.cell_id: r.z for r in cells.collect()} == {i: float(i) for i in range(35)}
    with pytest.raises(Exception):
        read_geotiff(spark, str(tmp_path / "none.tif"))


def test_lzw_codes_of_every_width():
    from talweg.sources.geotiff import unpack_lzw

    rnd = random.Random(5)
    for data in (b"", b"a", b"aaaaaaa" * 40, bytes(rnd.randrange(256) for _ in range(30_000)), bytes(rnd.randrange(3) for _ in range(60_000))):
        assert unpack_lzw(lzw(data)) == data


@pytest.mark.parametrize("kind,packing,predictor", [("<f4", 5, 3), ("<f8", 50000, 3), (">i2", 8, 2), ("<u2", 5, 2), ("<f4", 8, 1)])
@pytest.mark.parametrize("tile", [0, 4])
def test_geotiff_layouts(kind, packing, predictor, tile):
    from talweg.sources import geotiff

    rnd = np.random.default_rng(6)
    values = (rnd.normal(size=(9, 11)) * 300).astype(kind.replace(">", "<"))
    raw = tiff(values, kind.replace(">", "<"), packing, tile, predictor, tile == 4, 1)
    got = np.zeros((9, 11))
    for r, c, inside, stored, layout, data in geotiff.blocks(raw):
        block = layout.values(data, stored)[:inside, : 11 - c]
        got[r : r + len(block), c : c + block.shape[1]] = block
    assert np.array_equal(got, values.astype(float))


def test_stream_of_dems(spark, tmp_path):
    from talweg.streaming import flood_stream, read_cell_stream

    cells_of(spark, Z7, 1).withColumn("dem_id", F.lit("a")).select("dem_id", "cell_id", "z").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    flood_stream(read_cell_stream(spark, str(tmp_path / "in")), G7, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.cell_id: r.down_id for r in spark.read.parquet(f"{out}/0").collect()} == scalar.flood(Z7, 7, 7)[0]


# --- folds, numbers, systems, exports and stops ------------------------------------


def test_folds_on_arrays_follow_the_scalar_rule():
    from talweg.operators import trees

    rnd = np.random.default_rng(4)
    for n in (1, 2, 50, 400):
        nxt = np.array([rnd.integers(k + 1, min(n, k + 9)) if k + 1 < n and rnd.random() < 0.95 else -1 for k in range(n)])
        given: dict[int, list[int]] = {k: [] for k in range(n)}
        orders, opened = [], []
        for k in range(n):
            top = max(given[k], default=0)
            orders.append(top + (given[k].count(top) > 1) if given[k] else 1)
            if nxt[k] >= 0:
                given[nxt[k]].append(orders[-1])
        feeders: dict[int, list[int]] = {k: [] for k in range(n)}
        for k in range(n):
            opened.append(1 + sum(v for v in feeders[k] if v < 7))
            if nxt[k] >= 0:
                feeders[nxt[k]].append(opened[-1])
        assert trees.fold_arrays(nxt, trees.Strahler(n)).tolist() == orders
        assert trees.fold_arrays(nxt, trees.OpenCells(n, 7)).tolist() == opened


def test_rows_are_numbered_across_partitions(spark):
    from talweg.functions.ordering import numbered

    rows = spark.range(1000).select((F.col("id") * 7919 % 13).alias("a"), F.col("id").alias("b")).repartition(6)
    got = [(r.a, r.b) for r in numbered(rows, "k", F.desc("a"), "b").orderBy("k").collect()]
    assert got == sorted(((i * 7919 % 13, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert numbered(rows, "k", "b").agg(F.countDistinct("k"), F.min("k"), F.max("k")).first()[:] == (1000, 1, 1000)
    assert numbered(rows.where("false"), "k", "b").count() == 0


def test_least_cells_of_a_column(spark):
    values = [None, -3.0, 0.0, 1.0, 100.0, 100.1, 250.0, float("nan"), 1e9]
    g = Grid(5, 5)
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, a double").select("k", g.min_cells_of(F.col("a")).alias("n"))
    assert {r.k: r.n for r in got.collect()} == {k: g.min_cells(v) for k, v in enumerate(values)}


def test_reference_systems():
    kind = lambda crs: Grid(2, 2, crs=crs).projected
    assert kind("EPSG:28355") and kind("epsg:7855") and kind("EPSG:3857") and kind('PROJCS["x"]') and kind("EPSG:32633")
    assert kind("EPSG:4326") is False and kind("EPSG:4283") is False and kind("EPSG:7844") is False and kind('GEOGCS["x"]') is False
    assert kind("") is None and kind("local") is None and kind("EPSG:9001") is None


def test_systems_and_areas_without_data(spark):
    from talweg.operators import masks

    z = [[1.0] * 6 for _ in range(5)]
    z[1][1] = z[1][2] = z[3][4] = None
    cells = spark.createDataFrame([(r * 6 + c, z[r][c]) for r in range(5) for c in range(6)], "cell_id long, z double")
    g = Grid(5, 6, 0.0, 10.0, 0.0, 0.0, 0.0, -10.0, crs="EPSG:4326")
    ring = [[(0.0, 0.0), (45.0, 0.0), (45.0, -45.0), (0.0, -45.0)]]
    assert [c for c, _ in masks.validate(cells, g, ring)] == ["geographic_crs", "mask_nodata"]
    with pytest.raises(TerrainError, match="datum"):
        masks.validate(cells, g, ring, mask_crs="EPSG:28355")
    with pytest.raises(TerrainError, match="not known"):
        Terrain(g, cells, mask=ring, mask_crs="EPSG:31466")
    every, inside = masks.nodata_areas(cells, g).first(), masks.nodata_areas(cells, g, [[(0.0, 0.0), (38.0, 0.0), (38.0, -28.0), (0.0, -28.0)]]).first()
    assert every.area == 300.0 and inside.area == 200.0 and "mask" in inside.warning and "mask" not in every.warning
    assert masks.nodata_areas(cells.where("z is not null"), g).count() == 0


def test_impervious_shares_and_overwriting(spark, tmp_path, seven, model):
    outlets = sorted(r.outlet_id for r in model.select("outlet_id").distinct().collect())
    shares = spark.createDataFrame([(outlets[0], "40"), (outlets[1], "n/a"), (9999, "1")], "outlet_id long, impervious string")
    nodes, _ = models.rorb_network(model, seven.tree, G7, impervious=0.25, shares=shares)
    assert sorted(n.impervious for n in nodes.values()) == [0.0, 0.25, 0.25, 0.4]  # the outlet node has none
    path = str(tmp_path / "a")
    for write, error in ((models.write_rorb, RorbError), (models.write_wbnm, WbnmError), (models.write_xprafts, RaftsError)):
        out = write(model, seven.tree, G7, path)[0]
        before = open(out).read()
        with pytest.raises(error, match="overwrite"):
            write(model, seven.tree, G7, path)
        write(model, seven.tree, G7, path, overwrite=True)
        assert open(out).read() == before


def test_receivers_fall_back_and_steps_can_be_stopped(spark, seven):
    seen = []
    t = Terrain(G7, seven.all_cells, progress=seen.append)
    assert {(r.cell_id, r.down_id) for r in t.tree.select("cell_id", "down_id").collect()} == {(r.cell_id, r.down_id) for r in seven.tree.select("cell_id", "down_id").collect()}
    assert seen == ["cells", "receivers", "flood", "accumulation"]  # the surface has a pit
    t.cancel()
    with pytest.raises(Cancelled):
        t.flow_paths(2)
