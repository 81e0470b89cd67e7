"""Vector layers as files: Parquet, ESRI shapefiles, and the pair of GeoPackage layers of an export.

Shapefiles hold one dissolved shape each. GeoPackages are written by tasks, see talweg.sinks.geopackage.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talweg.operators.dissolve import dissolve, read_multipolygon, ring_area
from talweg.sinks.geopackage import from_gpkg_blob, read_gpkg, write_gpkg
from talweg.sources.grid import Grid, TerrainError, TuflowError


def write_parquet(layer: DataFrame, path: str, overwrite: bool = False) -> None:
    """A layer of any size, written in parallel."""
    layer.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


# --- shapefiles -------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """An attribute column; kind is string, integer or double."""

    name: str
    kind: str
    width: int
    precision: int = 0

    @property
    def spark(self) -> T.StructField:
        kind = {"string": T.StringType(), "integer": T.IntegerType(), "double": T.DoubleType()}[self.kind]
        return T.StructField(self.name, kind, True, {"width": self.width, "precision": self.precision})


def _dbf_cell(field: Field, value) -> bytes:
    if value is None:
        return b" " * field.width
    if field.kind == "string":
        return str(value).encode()[: field.width].ljust(field.width)
    text = f"{value:{field.width}.{field.precision}f}" if field.kind == "double" else f"{value:{field.width}d}"
    if len(text) > field.width:
        raise TerrainError(f"{value} is too wide for {field.name}")
    return text.encode()


def write_shapefile(path: str, fields: list[Field], rows: list[tuple[list, list]], wkt: str = "") -> None:
    """Polygon shapefile (.shp, .shx, .dbf, .cpg, and .prj if the reference system is known) of rows (values, multipolygon)."""
    base = Path(path).with_suffix("")
    shp, shx, boxes, at = b"", b"", [], 50
    for k, (_, parts) in enumerate(rows, 1):
        rings = []
        for polygon in parts:
            for j, ring in enumerate(polygon):
                clockwise = ring if (ring_area(ring) < 0) == (j == 0) else ring[::-1]  # outer rings clockwise, holes against
                rings.append([*clockwise, clockwise[0]])
        points = [p for r in rings for p in r]
        xs, ys = zip(*points)
        box = (min(xs), min(ys), max(xs), max(ys))
        boxes.append(box)
        starts, n = [], 0
        for r in rings:
            starts.append(n)
            n += len(r)
        body = struct.pack("<i4dii", 5, *box, len(rings), n) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in points)
        shx += struct.pack(">ii", at, len(body) // 2)
        shp += struct.pack(">ii", k, len(body) // 2) + body
        at += 4 + len(body) // 2
    box = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (0.0,) * 4

    def header(size: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + size // 2) + struct.pack("<ii8d", 1000, 5, *box, 0, 0, 0, 0)

    base.with_suffix(".shp").write_bytes(header(len(shp)) + shp)
    base.with_suffix(".shx").write_bytes(header(len(shx)) + shx)
    width = 1 + sum(f.width for f in fields)
    dbf = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(rows), 33 + 32 * len(fields), width)
    for f in fields:
        dbf += struct.pack("<11sc4xBB14x", f.name.encode()[:10], b"C" if f.kind == "string" else b"N", f.width, f.precision)
    dbf += b"\r" + b"".join(b" " + b"".join(map(_dbf_cell, fields, values)) for values, _ in rows) + b"\x1a"
    base.with_suffix(".dbf").write_bytes(dbf)
    base.with_suffix(".cpg").write_text("UTF-8")
    if wkt:
        base.with_suffix(".prj").write_text(wkt)


# TUFLOW region layers as file, fields and values: fixed values of the data formats. None is a blank.
TUFLOW_LAYERS = [
    ("2d_rf__s1_s2_e1_e2_e3_EXG_001_R", [Field("Name", "string", 100), Field("f1", "double", 15, 5), Field("f2", "double", 15, 5)], ["Rain_001", 1.0, 1.0]),
    ("2d_qnl__s1_s2_e1_e2_e3_EXG_001_R", [Field("Nest_Level", "integer", 8)], [None]),
    ("2d_po__s1_s2_e1_e2_e3_EXG_001_R", [Field("Type", "string", 20), Field("Label", "string", 30), Field("Comment", "string", 250)], [None, None, None]),
    ("2d_mat__s1_s2_e1_e2_e3_EXG_001_R", [Field("Material", "integer", 8)], [None]),
    ("2d_loc__s1_s2_e1_e2_e3_EXG_001_R", [Field("Comment", "string", 250)], ["Region_001"]),
    ("2d_code__s1_s2_e1_e2_e3_EXG_001_R", [Field("Code", "integer", 8)], [1]),
    ("2d_soil__s1_s2_e1_e2_e3_EXG_001_R", [Field("SoilID", "integer", 8)], [None]),
]


def write_tuflow(assigned: DataFrame, grid: Grid, folder: str, wkt: str = "", overwrite: bool = False) -> tuple[str, list[str], float]:
    """Seven region layers with the outline of all subcatchments; gives the folder, the files and the hectares."""
    from pyspark.sql import functions as F

    whole = dissolve(assigned.select(F.lit(0).cast("long").alias("group_id"), "cell_id"), grid).first()
    if whole is None:
        raise TerrainError("no subcatchment to write")
    out = Path(folder)
    files = [out / f"{name}.shp" for name, _, _ in TUFLOW_LAYERS]
    if not overwrite and any(f.exists() for f in files):
        raise TuflowError("the folder has these layers: pass overwrite")
    out.mkdir(parents=True, exist_ok=True)
    outline = read_multipolygon(bytes(whole.wkb))
    for file, (_, fields, values) in zip(files, TUFLOW_LAYERS):
        write_shapefile(str(file), fields, [(values, outline)], wkt)
    return str(out), [str(f) for f in files], round(whole.area / 1e4, 3)


def write_layers(paths: DataFrame, subcatchments: DataFrame | None, path: str, crs: str = "") -> None:
    """The two layers of an export: flow_paths starts the file, subcatchments (with their outlines) join it."""
    write_gpkg(paths, path, "flow_paths", "line", crs, overwrite_file=True)
    if subcatchments is not None:
        write_gpkg(subcatchments, path, "subcatchments", "wkb", crs)
