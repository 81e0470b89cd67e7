"""Grids that arrive one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talweg.operators.routing import flood
from talweg.sources.grid import Grid, is_valid

CELLS = "dem_id string, cell_id long, z double"


def read_cell_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Cells of Parquet files as they land in a folder; a DEM's cells must come in one file."""
    return spark.readStream.schema(CELLS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def flood_stream(cells: DataFrame, grid: Grid, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Floods each arriving DEM and hands the result of a batch to ``write``.

    DEMs are independent, so there is no state to keep; a batch that is run again after a
    failure has the same number, by which the writer can replace what it wrote.
    """

    def batch(rows: DataFrame, number: int) -> None:
        write(flood(rows.where(is_valid(F.col("z"), grid.nodata)), grid), number)

    return cells.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
