"""GeoTIFF by byte ranges: boxes, pushed-down comparisons, sparse and very large files, LZW speed."""

import os
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.sources import geotiff
from test_terrain import lzw, tiff


def sparse_bigtiff(path, width, height, block, stored, nodata=b"-9999\0"):
    """A tiled float32 BigTIFF in which only the blocks of ``stored`` {index: array} lie in the file, far apart."""
    n = -(-width // block) * -(-height // block)
    offsets, sizes, at = [0] * n, [0] * n, 1 << 20
    with open(path, "wb") as f:
        for k, values in sorted(stored.items()):
            offsets[k], sizes[k] = at, block * block * 4
            f.seek(at)
            f.write(np.ascontiguousarray(values, "<f4").tobytes())
            at += (5 << 30) // max(1, len(stored))
        tags = [(256, "Q", [width]), (257, "Q", [height]), (258, "H", [32]), (259, "H", [1]), (277, "H", [1]), (317, "H", [1]), (322, "I", [block]), (323, "I", [block]), (324, "Q", offsets), (325, "Q", sizes), (339, "H", [3]), (33550, "d", [1.0, 1.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (42113, "s", nodata)]
        f.seek(at)
        body, extra, base = b"", b"", at + 8 + 20 * len(tags) + 8
        for tag, code, held in tags:
            raw = held if code == "s" else struct.pack("<" + code * len(held), *held)
            body += struct.pack("<HHQ", tag, {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}[code], len(held))
            if len(raw) <= 8:
                body += raw.ljust(8, b"\0")
            else:
                body += struct.pack("<Q", base + len(extra))
                extra += raw
        f.write(struct.pack("<Q", len(tags)) + body + b"\0" * 8 + extra)
        f.seek(0)
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, at))


def test_sparse_file_beyond_four_gigabytes(spark, tmp_path):
    """Only blocks in the box are planned and read, wherever they lie; blocks that are not stored are nodata."""
    path, block, side = str(tmp_path / "big.tif"), 256, 40_000
    across = -(-side // block)
    first, far = np.arange(block * block).reshape(block, block), -np.arange(block * block).reshape(block, block)
    sparse_bigtiff(path, side, side, block, {0: first, across * 100 + 50: far})
    assert os.path.getsize(path) > 1 << 32
    assert len(geotiff.Image.of(geotiff._fetcher(path)).offsets) == across**2
    # cells of rows 25,600 and columns 12,800 on, and one block beside it that is not stored
    grid, cells = geotiff.read_geotiff(spark, path, box=(12_800.0, -25_656.0, 13_100.0, -25_600.0))
    assert (grid.rows, grid.cols, grid.nodata) == (side, side, -9999.0)
    assert cells.rdd.getNumPartitions() == 1
    got = {(r.r, r.c): r.z for r in cells.collect()}
    assert len(got) == 56 * 300 and {r for r, _ in got} == set(range(25_600, 25_656)) and {c for _, c in got} == set(range(12_800, 13_100))
    assert all(z == (far[r - 25_600, c - 12_800] if c < 13_056 else -9999.0) for (r, c), z in got.items())
    parts = geotiff.GeoTiffReader({"path": path}).partitions()  # the whole file: bounded groups
    assert len(parts) > 100 and max(p.blocks[:, 5].sum() for p in parts) <= geotiff.GROUP_BYTES and sum(len(p.blocks) for p in parts) == across**2


@pytest.mark.parametrize("packing,predictor,tile", [(1, 1, 0), (8, 2, 4), (5, 3, 0)])
@pytest.mark.parametrize("whole", [False, True])
def test_a_box_gives_the_cells_of_a_full_read(spark, tmp_path, packing, predictor, tile, whole):
    values = np.random.default_rng(3).integers(-500, 500, size=(23, 17)).astype(float).tolist()
    (tmp_path / "a.tif").write_bytes(tiff(values, "<f8", packing, tile, predictor, False, 1))
    every = {(r.r, r.c): r.z for r in geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), whole=whole)[1].collect()}
    assert every == {(r, c): values[r][c] for r in range(23) for c in range(17)}
    box = (106.0, 20.0, 121.0, 40.0)  # cells are 2 wide and 3 high from (100, 50)
    inside = {k: z for k, z in every.items() if box[0] <= 100 + 2 * (k[1] + 0.5) <= box[2] and box[1] <= 50 - 3 * (k[0] + 0.5) <= box[3]}
    assert {(r.r, r.c): r.z for r in geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), box, whole)[1].collect()} == inside and 0 < len(inside) < len(every)
    assert geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), (0.0, 0.0, 1.0, 1.0), whole)[1].count() == 0


def test_comparisons_are_pushed_down(spark, tmp_path):
    values = [[31 * r + c for c in range(31)] for r in range(40)]
    (tmp_path / "a.tif").write_bytes(tiff(values, "<f4", 8, 8, 1, False, 1))
    spark.dataSource.register(geotiff.GeoTiffSource)
    spark.conf.set(geotiff.PUSHDOWN, "true")
    try:
        cells = spark.read.format("geotiff").option("path", str(tmp_path)).option("pushdown", "true").load()
        near = cells.where((F.col("r") >= 9) & (F.col("r") < 16) & (F.col("c") == 20) & (F.col("z") > 0))
        assert {r.cell_id for r in near.collect()} == {31 * r + 20 for r in range(9, 16)}
    finally:
        spark.conf.unset(geotiff.PUSHDOWN)
    reader = geotiff._PushedReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    left = list(reader.pushFilters([GreaterThanOrEqual(("r",), 9), LessThan(("r",), 16), EqualTo(("c",), 20), LessThan(("z",), 1.5)]))
    assert len(left) == 4
    planned = np.concatenate([p.blocks for p in reader.partitions()])
    assert planned[:, :2].tolist() == [[8, 16]]


def test_large_plain_strips_are_cut_by_rows(monkeypatch):
    values = np.arange(60 * 50).reshape(60, 50).tolist()
    raw = tiff(values, "<f4", 1, 0, 2, False, 2)
    image = geotiff.Image.of(raw)
    whole = list(geotiff.blocks(raw))
    monkeypatch.setattr(geotiff, "GROUP_CELLS", 600)
    cut = list(geotiff.blocks(raw))
    assert len(cut) >= len(whole) and image.grid.rows == 60
    for parts in (whole, cut):
        got = np.concatenate([x.values(data, stored)[:inside] for _, _, inside, stored, x, data in parts])
        assert np.array_equal(got, np.array(values))


def test_lzw_unpacks_fast():
    rnd = random.Random(9)
    for data in (bytes(rnd.randrange(256) for _ in range(200_000)), bytes(rnd.randrange(4) for _ in range(400_000)), b"\0" * 300_000):
        packed = lzw(data)
        best = min(_seconds(packed, data) for _ in range(3))
        print(f"{len(data) / best / 1e6:.0f} MB/s")
        assert len(data) / best > 2e6  # above 10 MB/s on an idle machine


def _seconds(packed, data):
    began = time.process_time()
    assert geotiff.unpack_lzw(packed) == data
    return time.process_time() - began


def test_broken_data_raises():
    with pytest.raises(geotiff.TerrainError, match="not a TIFF"):
        geotiff.header(b"no tiff at all, but long enough")
    bits = format(256, "09b") + format(300, "09b") + "0" * 6
    with pytest.raises(geotiff.TerrainError, match="LZW"):
        geotiff.unpack_lzw(int(bits, 2).to_bytes(3, "big"))
