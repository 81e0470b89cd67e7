"""GeoPackage layers, written and read by tasks, with the spatial index of the format.

Writing is a Python data source: each task writes its rows and their boxes to a part file
beside the GeoPackage, and the commit appends the parts to the layer's table in SQLite, in the
order of the partitions, and fills the R-tree. No row passes Spark's driver or its memory.
Reading deals ranges of row numbers to tasks, which query the file; a box asks the R-tree.
The file's folder must be one that all executors see, as SQLite files are.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from talweg.operators.dissolve import line_wkb, read_multipolygon
from talweg.sources.grid import TerrainError

ROWS = 50_000  # of a task that reads
_SQL_TYPE = {T.LongType: "INTEGER", T.IntegerType: "MEDIUMINT", T.ShortType: "SMALLINT", T.DoubleType: "DOUBLE", T.StringType: "TEXT", T.BooleanType: "BOOLEAN"}
_TABLES = """
CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id));
CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
CREATE TABLE IF NOT EXISTS gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL, UNIQUE (table_name, column_name, extension_name));
CREATE TABLE IF NOT EXISTS layer_styles (id INTEGER PRIMARY KEY AUTOINCREMENT, f_table_name TEXT, f_geometry_column TEXT, styleName TEXT, styleSLD TEXT, useAsDefault BOOLEAN);
"""
# What the format asks for: the extension's name and definition, and the bytes of each kind of envelope: fixed values.
_RTREE = ("gpkg_rtree_index", "http://www.geopackage.org/spec120/#extension_rtree", "write-only")
_ENVELOPES = (0, 32, 48, 48, 64)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def gpkg_blob(wkb: bytes, srs: int, box: tuple[float, float, float, float]) -> bytes:
    """A geometry with its header and envelope (xmin, ymin, xmax, ymax)."""
    return b"GP\x00\x03" + struct.pack("<i4d", srs, box[0], box[2], box[1], box[3]) + wkb


def from_gpkg_blob(blob: bytes) -> bytes:
    return blob[8 + _ENVELOPES[blob[3] >> 1 & 7] :]


def extent(wkb: bytes) -> tuple[float, float, float, float]:
    """xmin, ymin, xmax, ymax of a line or multipolygon."""
    if wkb[1] == 2:
        points = [struct.unpack_from("<dd", wkb, 9 + 16 * i) for i in range(struct.unpack_from("<I", wkb, 5)[0])]
    else:
        points = [p for part in read_multipolygon(wkb) for ring in part for p in ring]
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


@dataclass
class _Part(WriterCommitMessage):
    order: int
    file: str


class GpkgWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.table, self.geometry, self.parts = (options[k] for k in ("path", "table", "geometry", "parts"))
        self.srs, self.crs = int(options["srs"]), options.get("crs", "")
        self.style = options.get("style")
        self.fresh = options.get("fresh") == "true"
        self.lines = isinstance(schema[self.geometry].dataType, T.ArrayType)
        self.fields = [(f.name, _SQL_TYPE[type(f.dataType)]) for f in schema.fields if f.name != self.geometry]
        self.names = [f.name for f in schema.fields]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        os.makedirs(self.parts, exist_ok=True)
        file = f"{self.parts}/{task.partitionId()}-{task.taskAttemptId()}"
        db = sqlite3.connect(file)
        try:
            columns = ", ".join(f"{quoted(n)} {kind}" for n, kind in self.fields)
            db.execute(f"CREATE TABLE part (_shape BLOB, _x0 DOUBLE, _x1 DOUBLE, _y0 DOUBLE, _y1 DOUBLE{', ' if columns else ''}{columns})")
            into = f"INSERT INTO part VALUES ({', '.join('?' * (5 + len(self.fields)))})"
            for b in iterator:
                shapes = b.column(self.names.index(self.geometry)).to_pylist()
                other = [b.column(self.names.index(n)).to_pylist() for n, _ in self.fields]
                db.executemany(into, (self._row(shape, values) for shape, *values in zip(shapes, *other)))
            db.commit()
        finally:
            db.close()
        return _Part(task.partitionId(), file)

    def _row(self, shape, values: list) -> tuple:
        if shape is None or not len(shape):
            return (None, None, None, None, None, *values)
        wkb = line_wkb([(p["x"], p["y"]) for p in shape]) if self.lines else shape
        box = extent(wkb)
        return (gpkg_blob(wkb, self.srs, box), box[0], box[2], box[1], box[3], *values)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.fresh and os.path.exists(self.path):
            os.unlink(self.path)
        table, geometry, tree = self.table, self.geometry, f"rtree_{self.table}_{self.geometry}"
        kind = "LINESTRING" if self.lines else "MULTIPOLYGON"
        db = sqlite3.connect(self.path, isolation_level=None)
        try:
            db.execute("PRAGMA application_id = 1196444487")
            db.execute("PRAGMA user_version = 10300")
            db.executescript(_TABLES)
            for srs, name, by in ((-1, "undefined cartesian", "NONE"), (0, "undefined geographic", "NONE"), (self.srs, self.crs or "undefined cartesian", "EPSG" if self.srs > 0 else "NONE")):
                db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", (name, srs, by, srs))
            for old in (table, tree):
                db.execute(f"DROP TABLE IF EXISTS {quoted(old)}")
            for name in ("gpkg_contents", "gpkg_geometry_columns", "gpkg_extensions"):
                db.execute(f"DELETE FROM {name} WHERE table_name = ?", (table,))
            columns = ", ".join(f"{quoted(n)} {x}" for n, x in self.fields)
            db.execute(f"CREATE TABLE {quoted(table)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, {quoted(geometry)} {kind}{', ' if columns else ''}{columns})")
            db.execute(f"CREATE VIRTUAL TABLE {quoted(tree)} USING rtree(id, minx, maxx, miny, maxy)")
            into = ", ".join(quoted(n) for n in [geometry, *(n for n, _ in self.fields)])
            values = ", ".join(["_shape", *(quoted(n) for n, _ in self.fields)])
            last = 0
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.order):
                db.execute("ATTACH DATABASE ? AS part", (part.file,))
                db.execute("BEGIN")
                db.execute(f"INSERT INTO {quoted(table)} ({into}) SELECT {values} FROM part.part ORDER BY rowid")
                db.execute(f"INSERT INTO {quoted(tree)} SELECT rowid + ?, _x0, _x1, _y0, _y1 FROM part.part WHERE _shape IS NOT NULL", (last,))
                last += db.execute("SELECT count(*) FROM part.part").fetchone()[0]
                db.execute("COMMIT")
                db.execute("DETACH DATABASE part")
            box = db.execute(f"SELECT min(minx), min(miny), max(maxx), max(maxy) FROM {quoted(tree)}").fetchone()
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (table, table, *box, self.srs))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, ?, ?, 0, 0)", (table, geometry, kind, self.srs))
            db.execute("INSERT INTO gpkg_extensions VALUES (?, ?, ?, ?, ?)", (table, geometry, *_RTREE))
            if self.style is not None:
                db.execute("DELETE FROM layer_styles WHERE f_table_name = ?", (table,))
                db.execute("INSERT INTO layer_styles (f_table_name, f_geometry_column, styleName, styleSLD, useAsDefault) VALUES (?, ?, 'default', ?, 1)", (table, geometry, self.style))
        finally:
            db.close()
            shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _layer(path: str, table: str) -> tuple[str, list[tuple[str, str]]]:
    """The layer's geometry column, and its columns with their types."""
    if not os.path.exists(path):
        raise TerrainError(f"there is no {path}")
    db = _open(path)
    try:
        found = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (table,)).fetchone()
        if found is None:
            raise TerrainError(f"the file has no layer {table}")
        return found[0], [(r[1], r[2].upper()) for r in db.execute(f"PRAGMA table_info({quoted(table)})")]
    finally:
        db.close()


@dataclass
class _Range(InputPartition):
    first: int
    end: int


class GpkgReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table = options["path"], options["table"]
        self.box = tuple(map(float, options["box"].split(","))) if options.get("box") else None
        self.geometry, self.columns = _layer(self.path, self.table)

    def partitions(self):
        db = _open(self.path)
        low, high = db.execute(f"SELECT min(fid), max(fid) FROM {quoted(self.table)}").fetchone()
        db.close()
        return [_Range(k, k + ROWS) for k in range(low, high + 1, ROWS)] if low is not None else [_Range(0, 0)]

    def read(self, p: _Range) -> Iterator[tuple]:
        db = _open(self.path)
        try:
            sql, values = f"SELECT * FROM {quoted(self.table)} WHERE fid >= ? AND fid < ?", [p.first, p.end]
            if self.box:
                sql += f" AND fid IN (SELECT id FROM {quoted(f'rtree_{self.table}_{self.geometry}')} WHERE id >= ? AND id < ? AND maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)"
                values += [p.first, p.end, self.box[0], self.box[2], self.box[1], self.box[3]]
            for row in db.execute(sql, values):
                yield tuple(from_gpkg_blob(v) if n == self.geometry and v is not None else bool(v) if kind == "BOOLEAN" and v is not None else v for (n, kind), v in zip(self.columns, row))
        finally:
            db.close()


class GpkgSource(DataSource):
    """Format gpkg; see write_gpkg and read_gpkg for its options."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> T.StructType:
        geometry, columns = _layer(self.options["path"], self.options["table"])
        back = {v: k() for k, v in _SQL_TYPE.items()}
        return T.StructType([T.StructField(n, T.BinaryType() if n == geometry else back.get(t, T.StringType())) for n, t in columns])

    def reader(self, schema) -> DataSourceReader:
        return GpkgReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return GpkgWriter(dict(self.options), schema)


def write_gpkg(layer: DataFrame, path: str, table: str, geometry: str = "geom", crs: str = "", overwrite_file: bool = False, overwrite_layer: bool = True, style: str | None = None) -> int:
    """Writes a layer as a table of a GeoPackage with an R-tree; gives its number of rows.

    geometry: a WKB column, or a line as an array of points; rows without one stay, outside the index.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    digits = crs.upper().removeprefix("EPSG:")
    srs = int(digits) if crs.upper().startswith("EPSG:") and digits.isdigit() else -1
    if unknown := [f.name for f in layer.schema.fields if f.name != geometry and type(f.dataType) not in _SQL_TYPE]:
        raise TerrainError(f"no GeoPackage type for {', '.join(unknown)}")
    if os.path.exists(path) and not overwrite_file and not overwrite_layer:
        db = _open(path)
        there = db.execute("SELECT count(*) FROM sqlite_master WHERE name = 'gpkg_contents'").fetchone()[0] and db.execute("SELECT 1 FROM gpkg_contents WHERE table_name = ?", (table,)).fetchone()
        db.close()
        if there:
            raise TerrainError(f"the file has a layer {table}")
    layer.sparkSession.dataSource.register(GpkgSource)
    out = layer.write.format("gpkg").mode("append").option("path", os.path.abspath(path)).option("table", table).option("geometry", geometry).option("crs", crs).option("srs", str(srs))
    out = out.option("parts", f"{os.path.abspath(path)}.parts-{uuid.uuid4().hex}").option("fresh", str(overwrite_file).lower())
    (out if style is None else out.option("style", style)).save()
    db = _open(path)
    try:
        return db.execute(f"SELECT count(*) FROM {quoted(table)}").fetchone()[0]
    finally:
        db.close()


def read_gpkg(spark: SparkSession, path: str, table: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A layer of a GeoPackage with its geometry as WKB; with a box (xmin, ymin, xmax, ymax), the rows whose boxes meet it, by the R-tree."""
    _layer(path, table)  # raises here, by its own name, if there is none
    spark.dataSource.register(GpkgSource)
    reader = spark.read.format("gpkg").option("path", os.path.abspath(path)).option("table", table)
    return (reader if box is None else reader.option("box", ",".join(repr(float(v)) for v in box))).load()


__all__ = ["from_gpkg_blob", "read_gpkg", "write_gpkg"]
