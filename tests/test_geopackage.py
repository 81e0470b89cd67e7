"""GeoPackage layers by tasks: parts in order, the R-tree, boxes, empty layers, failures."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from talweg.sinks import geopackage
from talweg.sources.grid import TerrainError


def lines(spark, n, parts=5):
    point = lambda dx: F.struct((F.col("id") * 1.0 + dx).alias("x"), (F.col("id") % 10 * 2.0 + dx).alias("y"))
    return spark.range(0, n, 1, parts).select(F.col("id").alias("k"), F.array(point(0.0), point(0.5)).alias("line"), F.concat(F.lit("é "), F.col("id")).alias("name"), (F.col("id") % 2 == 0).alias("even"), F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("v"))


def test_parts_index_and_boxes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "deep" / "a.gpkg")
    df = lines(spark, 103)
    assert geopackage.write_gpkg(df, path, "ways", "line", "EPSG:28355", overwrite_file=True, style="<style/>") == 103
    assert os.listdir(tmp_path / "deep") == ["a.gpkg"]  # no parts are left
    db = sqlite3.connect(path)
    assert [r[0] for r in db.execute("SELECT k FROM ways ORDER BY fid")] == list(range(103))
    assert db.execute("SELECT count(*) FROM rtree_ways_line").fetchone()[0] == 103
    assert db.execute("SELECT min_x, min_y, max_x, max_y, srs_id FROM gpkg_contents").fetchone() == (0.0, 0.0, 102.5, 18.5, 28355)
    assert db.execute("SELECT extension_name FROM gpkg_extensions").fetchall() == [("gpkg_rtree_index",)] and db.execute("SELECT styleSLD FROM layer_styles").fetchall() == [("<style/>",)]
    inside = {r[0] for r in db.execute("SELECT id FROM rtree_ways_line WHERE minx <= 40 AND maxx >= 30 AND miny <= 6 AND maxy >= 0")}
    db.close()
    monkeypatch.setattr(geopackage, "ROWS", 20)
    back = geopackage.read_gpkg(spark, path, "ways")
    key = lambda r: (r.k, r["name"], r.even, r.v)
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    near = geopackage.read_gpkg(spark, path, "ways", (30.0, 0.0, 40.0, 6.0))
    want = {k for k in range(103) if k <= 40 and k + 0.5 >= 30 and k % 10 * 2 <= 6}
    assert {r.k for r in near.collect()} == want == {i - 1 for i in inside}
    assert geopackage.read_gpkg(spark, path, "ways", (-9.0, -9.0, -8.0, -8.0)).count() == 0


def test_layers_beside_layers(spark, tmp_path):
    path = str(tmp_path / "b.gpkg")
    geopackage.write_gpkg(lines(spark, 4), path, "one", "line")
    geopackage.write_gpkg(lines(spark, 6), path, "two", "line")
    geopackage.write_gpkg(lines(spark, 3, 1), path, "one", "line")  # again, over the first
    assert [geopackage.read_gpkg(spark, path, t).count() for t in ("one", "two")] == [3, 6]
    with pytest.raises(TerrainError, match="has a layer"):
        geopackage.write_gpkg(lines(spark, 3), path, "two", "line", overwrite_layer=False)
    with pytest.raises(TerrainError, match="no layer"):
        geopackage.read_gpkg(spark, path, "three")
    with pytest.raises(TerrainError, match="no GeoPackage type"):
        geopackage.write_gpkg(lines(spark, 3).withColumn("m", F.create_map(F.lit(1), F.lit(2))), path, "two", "line")
    none = lines(spark, 4).where("false")
    assert geopackage.write_gpkg(none, path, "none", "line", overwrite_file=True) == 0 and geopackage.read_gpkg(spark, path, "none").count() == 0
    nulls = lines(spark, 4).withColumn("line", F.when(F.col("k") != 2, F.col("line")))
    assert geopackage.write_gpkg(nulls, path, "nulls", "line") == 4
    assert geopackage.read_gpkg(spark, path, "nulls").where("line is null").count() == 1 and geopackage.read_gpkg(spark, path, "nulls", (0.0, 0.0, 99.0, 99.0)).count() == 3


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "c.gpkg")
    bad = lines(spark, 10).withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("stop")).cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="stop"):
        geopackage.write_gpkg(bad, path, "ways", "line")
    assert os.listdir(tmp_path) == []


def test_blobs():
    wkb = geopackage.line_wkb([(1.0, 2.0), (3.0, 5.0)])
    assert geopackage.extent(wkb) == (1.0, 2.0, 3.0, 5.0)
    blob = geopackage.gpkg_blob(wkb, 28355, (1.0, 2.0, 3.0, 5.0))
    assert geopackage.from_gpkg_blob(blob) == wkb and geopackage.from_gpkg_blob(b"GP\x00\x01\x00\x00\x00\x00" + wkb) == wkb
