"""Elevation grids: the header, cells from tables, Parquet and ESRI ASCII text, and validity."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class TerrainError(Exception):
    """An input or a network that the engine cannot work on."""


class BuildError(TerrainError):
    """No drainage network can be built."""


class Cancelled(TerrainError):
    """The run was stopped."""


class CatgError(TerrainError):
    """A ``.catg`` file that cannot be read."""


class ExportError(TerrainError):
    """A file that cannot be written."""


class RorbError(ExportError):
    """A RORB export."""


class WbnmError(ExportError):
    """A WBNM export."""


class RaftsError(ExportError):
    """An XP-RAFTS export."""


class TuflowError(ExportError):
    """A TUFLOW export."""


@dataclass(frozen=True)
class Grid:
    """Header of a north-up grid, in the order of a geotransform."""

    rows: int
    cols: int
    x0: float = 0.0
    dx: float = 10.0
    rx: float = 0.0
    y0: float = 0.0
    ry: float = 0.0
    dy: float = -10.0
    nodata: float | None = None
    crs: str = ""

    def __post_init__(self):
        if abs(self.rx) > 1e-12 or abs(self.ry) > 1e-12:
            raise TerrainError("rotated or skewed grids are not supported")

    @property
    def cell_width(self) -> float:
        return abs(self.dx)

    @property
    def cell_height(self) -> float:
        return abs(self.dy)

    @property
    def cell_area(self) -> float:
        return self.cell_width * self.cell_height

    @property
    def projected(self) -> bool | None:
        """Whether the reference system is a projected one; None where its name does not tell."""
        name = self.crs.strip().upper()
        if name.startswith(("PROJCS", "PROJCRS")):
            return True
        if name.startswith(("GEOGCS", "GEOGCRS", "GEODCRS", "GEOCCS")):
            return False
        code = name.removeprefix("EPSG:")
        if not name.startswith("EPSG:") or not code.isdigit():
            return None
        # blocks of the EPSG register that hold systems of one kind: fixed values
        if any(a <= int(code) <= b for a, b in ((4001, 4329), (4600, 4646), (4657, 4824), (7843, 7844))):
            return False
        return True if any(a <= int(code) <= b for a, b in ((2000, 3999), (7845, 7859), (20000, 32766))) else None

    def min_cells_of(self, area_m2: Column) -> Column:
        """min_cells() of a column of areas."""
        area = area_m2.try_cast("double")
        whole = F.ceil(area / F.lit(self.cell_area)) if self.cell_area > 0 else F.lit(1)
        return F.when((area > 0) & ~F.isnan(area), F.greatest(F.lit(1).cast("long"), whole)).otherwise(1).cast("long")

    def min_cells(self, area_m2) -> int:
        """Least number of cells of an area; 1 for what is no positive number."""
        try:
            area = float(area_m2)
        except (TypeError, ValueError):
            return 1
        return max(1, math.ceil(area / self.cell_area)) if area > 0 and self.cell_area > 0 else 1


def clean_path(uri: str) -> str:
    """A source's path without the layer part after ``|``."""
    return uri.split("|", 1)[0]


def is_valid(z: Column, nodata: float | None = None) -> Column:
    """A finite number that is not the nodata value."""
    ok = z.isNotNull() & ~F.isnan(z) & (F.abs(z) != float("inf"))
    return ok & (z != nodata) if nodata is not None and math.isfinite(nodata) else ok


def valid_cells(cells: DataFrame, grid: Grid) -> DataFrame:
    """(cell_id, z) of the valid cells; z is null in none."""
    return cells.where(is_valid(F.col("z"), grid.nodata)).select(F.col("cell_id").cast("long").alias("cell_id"), F.col("z").cast("double").alias("z"))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Parquet cells: dem_id, cell_id, r, c, z."""
    return spark.read.parquet(clean_path(path))


def list_grids(spark: SparkSession) -> list[str]:
    """Names of the catalog's tables and views that hold cells."""
    return sorted(t.name for t in spark.catalog.listTables() if {"cell_id", "z"} <= {c.name for c in spark.catalog.listColumns(t.name)})


# ESRI ASCII header names, lower case: fixed values.
HEADER = ("ncols", "nrows", "xllcorner", "xllcenter", "yllcorner", "yllcenter", "cellsize", "nodata_value")


def read_ascii_grid(spark: SparkSession, path: str, crs: str = "") -> tuple[Grid, DataFrame]:
    """Grid and cells (cell_id, r, c, z) of an ESRI ASCII grid with one grid row to a line.

    Lines are numbered by their byte offsets, so the text is read in parallel; the driver
    sees the header and one number for each split.
    """
    lines = spark.read.text(clean_path(path)).withColumn("at", F.monotonically_increasing_id())
    words = F.split(F.trim("value"), r"\s+")
    named = lines.where(F.lower(words[0]).isin(*HEADER)).select(F.lower(words[0]).alias("k"), words[1].cast("double").alias("v"))
    head = {r.k: r.v for r in named.limit(2 * len(HEADER)).collect()}
    if not {"ncols", "nrows", "cellsize"} <= set(head):
        raise TerrainError("the ASCII grid has no ncols, nrows and cellsize")
    rows, cols, size = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
    left = head.get("xllcorner", head.get("xllcenter", 0.0) - size / 2)
    low = head.get("yllcorner", head.get("yllcenter", 0.0) - size / 2)
    grid = Grid(rows, cols, left, size, 0.0, low + rows * size, 0.0, -size, head.get("nodata_value"), crs)
    body = lines.where((F.trim("value") != "") & ~F.lower(words[0]).isin(*HEADER))
    part = F.shiftright("at", 33)  # Spark's partition number
    counts = {r.p: r.n for r in body.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    if total != rows:
        raise TerrainError(f"the ASCII grid has {total} rows of {rows}")
    start = spark.createDataFrame([(int(p), n) for p, n in before.items()], "p long, before long")
    numbered = body.withColumn("p", part).join(F.broadcast(start), "p").withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("at")) - 1)
    cells = numbered.select("r", F.posexplode(F.transform(words, lambda w: w.try_cast("double"))).alias("c", "z"))
    return grid, cells.select((F.col("r") * cols + F.col("c")).alias("cell_id"), "r", F.col("c").cast("long").alias("c"), "z")


def _from_table(spark: SparkSession, sf_dir: str, table: str, key: str, cols: int, z: Column) -> tuple[Grid, DataFrame]:
    t = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cell = F.col(key).cast("long")
    cells = t.select(cell.alias("cell_id"), F.floor(cell / cols).cast("long").alias("r"), F.pmod(cell, F.lit(cols)).cast("long").alias("c"), z.alias("z"))
    last = t.agg(F.max(key)).first()[0]
    return Grid(int(last) // cols + 1, cols), cells


def branching(spark: SparkSession, sf_dir: str) -> tuple[Grid, DataFrame]:
    """A slope with branching streams, without pits, from the orders."""
    r = F.floor(F.col("o_orderkey") / 125)
    return _from_table(spark, sf_dir, "orders", "o_orderkey", 125, F.lit(10.0) * r + F.lit(9.9) * F.col("o_totalprice") / F.lit(500000.0))


def valley(spark: SparkSession, sf_dir: str) -> tuple[Grid, DataFrame]:
    """One valley with a main stem, without pits, from the orders."""
    r, c = F.floor(F.col("o_orderkey") / 125), F.pmod("o_orderkey", F.lit(125))
    return _from_table(spark, sf_dir, "orders", "o_orderkey", 125, F.lit(10.0) * r + F.lit(2.0) * F.abs(c - 62) + F.col("o_totalprice") / F.lit(500000.0))


def pitted(spark: SparkSession, sf_dir: str) -> tuple[Grid, DataFrame]:
    """A rough surface full of pits, from the customers."""
    return _from_table(spark, sf_dir, "customer", "c_custkey", 25, F.col("c_acctbal"))


def ramp(spark: SparkSession, sf_dir: str) -> tuple[Grid, DataFrame]:
    """A ramp with many ties, from the parts."""
    return _from_table(spark, sf_dir, "part", "p_partkey", 50, F.col("p_retailprice"))


__all__ = ["Grid", "TerrainError", "branching", "clean_path", "is_valid", "list_grids", "pitted", "ramp", "read_ascii_grid", "read_cells", "valid_cells", "valley"]
