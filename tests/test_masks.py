"""Masks from layers: WKB, holes, rings that cross themselves, and other reference systems."""

import struct

import pytest
from pyspark.sql import functions as F

from talweg.engine import Terrain
from talweg.functions import projections
from talweg.operators import masks
from talweg.sinks import layers
from talweg.sources.grid import Grid, TerrainError

GRID = Grid(12, 15, 300_000.0, 10.0, 0.0, 5_800_000.0, 0.0, -10.0, crs="EPSG:28355")
OUTER = [(300_004.3, 5_799_996.1), (300_121.7, 5_799_991.4), (300_112.6, 5_799_903.9), (300_011.2, 5_799_893.3)]  # no corner lies on a cell's side
HOLE = [(300_044.0, 5_799_966.0), (300_076.0, 5_799_966.0), (300_076.0, 5_799_934.0), (300_044.0, 5_799_934.0)]


def polygon(*rings, order="<", code=3, z=False):
    out = struct.pack(order + "BII", order == "<", code, len(rings))
    for ring in rings:
        ring = [*ring, ring[0]]
        out += struct.pack(order + "I", len(ring)) + b"".join(struct.pack(order + "d" * (3 if z else 2), *p, *([7.0] * z)) for p in ring)
    return out


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, float(i)) for i in range(12 * 15)], "cell_id long, z double")


def ids(df):
    return {r.cell_id for r in df.collect()}


def test_wkb_of_all_kinds():
    flat = [(0, OUTER + OUTER[:1]), (0, HOLE + HOLE[:1])]
    for wkb in (polygon(OUTER, HOLE), polygon(OUTER, HOLE, order=">"), polygon(OUTER, HOLE, code=1003, z=True), polygon(OUTER, HOLE, code=0x80000003, z=True)):
        assert masks.wkb_rings(wkb) == flat
    multi = struct.pack("<BII", 1, 6, 2) + polygon(OUTER) + polygon(HOLE)
    assert masks.wkb_rings(multi) == [(0, flat[0][1]), (1, flat[1][1])]
    assert masks.wkb_rings(struct.pack("<BIdd", 1, 1, 1.0, 2.0)) == []


def test_layers_with_holes_and_copies(spark, cells):
    solid, hole = ids(masks.in_mask(cells, GRID, [OUTER])), ids(masks.in_mask(cells, GRID, [HOLE]))
    layer = lambda *w: masks.mask_layer(spark.createDataFrame([(x,) for x in w], "geom binary"))
    ring = ids(masks.in_mask(cells, GRID, layer(polygon(OUTER, HOLE))))
    assert ring < solid and solid - ring < hole  # cells that the hole's edge touches stay
    assert len(solid - ring) == 4
    assert ids(masks.in_mask(cells, GRID, layer(polygon(OUTER), polygon(OUTER), None))) == solid
    assert ids(masks.in_mask(cells, GRID, layer(polygon(OUTER, HOLE), polygon(HOLE)))) == solid
    # a bow tie keeps both halves
    tie = [(300_000.0, 5_800_000.0), (300_100.0, 5_799_900.0), (300_100.0, 5_800_000.0), (300_000.0, 5_799_900.0)]
    got = ids(masks.in_mask(cells, GRID, layer(polygon(tie))))
    assert {15 * 4 + 1, 15 * 4 + 8} <= got and not {15 * 0 + 5, 15 * 9 + 5} & got
    q = masks.mask_quality(cells, GRID, layer(polygon(OUTER))).first()
    assert (q.has_mask, q.mask_cells) == (True, len(solid))
    assert masks.in_mask(cells, GRID, layer()).count() == 0
    with pytest.raises(TerrainError, match="no polygon"):
        masks.validate(cells, GRID, layer())


@pytest.mark.parametrize("crs", ["EPSG:4283", "EPSG:28354", "EPSG:3577", "EPSG:3112"])
def test_masks_of_other_systems(spark, cells, crs):
    """A mask converted there and taken back meets the same cells, as a drawing and as a layer, in the engine too."""
    there = projections.transform("EPSG:28355", crs)
    drawn = [[there(*p) for p in OUTER]]
    want = ids(masks.in_mask(cells, GRID, [OUTER]))
    assert ids(masks.in_mask(cells, GRID, masks.mask_in_grid(GRID, drawn, crs))) == want
    layer = masks.mask_layer(spark.createDataFrame([(polygon(*drawn),)], "geom binary"))
    t = Terrain(GRID, cells, mask=layer, mask_crs=crs)
    assert ids(t.cells) == want
    assert masks.validate(cells, GRID, layer, mask_crs=crs) == []
    with pytest.raises(TerrainError, match="outside"):
        masks.validate(cells, GRID, drawn, mask_crs="EPSG:28355")


def test_a_mask_from_a_geopackage(spark, cells, tmp_path):
    layers.write_gpkg(spark.createDataFrame([(1, struct.pack("<BII", 1, 6, 1) + polygon(OUTER, HOLE))], "id long, geom binary"), str(tmp_path / "m.gpkg"), "mask", crs="EPSG:28355")
    layer = masks.mask_layer(layers.read_gpkg(spark, str(tmp_path / "m.gpkg"), "mask"))
    assert layer.where(F.size("points") == 5).count() == 2
    assert len(ids(masks.in_mask(cells, GRID, [OUTER])) - ids(masks.in_mask(cells, GRID, layer))) == 4
