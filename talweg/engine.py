"""One fluent object for a grid: each step gives a DataFrame, and steps that others build on are written once."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions import jobs
from talweg.functions.lineage import cut
from talweg.operators import catchments, masks, routing, streams
from talweg.sources.grid import BuildError, Cancelled, Grid, TerrainError, is_valid

MIN_ACC = 10_000  # cells from which paths are shown
MIN_AREA = 100_000.0  # square metres of a subcatchment


class Terrain:
    """cells (cell_id, z) of a grid, perhaps behind a mask: rings, or a layer's table of them, in mask_crs or the grid's own system.

    receivers: ``lowest`` is one distributed aggregate, and raises where a pit or tied lowest
    neighbours make the exact receivers another; ``exact`` floods the DEM in one task and
    settles pits and ties; ``auto`` takes the first unless it raises. Steps that are written
    call ``progress`` with their name and run under the job tag ``tag``; cancel(), from
    another thread, stops them, and they raise Cancelled.
    """

    def __init__(self, grid: Grid, cells: DataFrame, mask: masks.Mask | None = None, receivers: str = "auto", mask_crs: str = "", progress: Callable[[str], None] | None = None, tag: str = "talweg"):
        if receivers not in ("auto", "exact", "lowest"):
            raise TerrainError("receivers: auto, exact or lowest")
        self.masked = not masks.no_mask(mask)
        self.grid, self.how = grid, receivers
        self.mask = masks.mask_in_grid(grid, mask, mask_crs) if self.masked else None
        self.all_cells = cells
        self.progress, self.tag, self.stopped = progress, tag, False

    def cancel(self) -> None:
        """Stops the running step and all later ones."""
        self.stopped = True
        jobs.cancel(self.all_cells.sparkSession, self.tag)

    def _step(self, name: str, source: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if self.stopped:
            raise Cancelled(name)
        if self.progress:
            self.progress(name)
        try:
            with jobs.tagged(self.all_cells.sparkSession, self.tag):
                return cut(make(source))
        except Exception as e:
            if self.stopped:
                raise Cancelled(name) from e
            raise

    @cached_property
    def cells(self) -> DataFrame:
        """(cell_id, z) of valid cells."""
        if self.masked:
            got = masks.mask_filter(self.all_cells, self.grid, self.mask)
        else:
            got = self.all_cells.where(is_valid(F.col("z"), self.grid.nodata)).select(F.col("cell_id").cast("long").alias("cell_id"), F.col("z").cast("double").alias("z"))
        got = self._step("cells", got, lambda got: got)
        if got.isEmpty():
            raise BuildError("no valid cell")
        return got

    @cached_property
    def receivers(self) -> DataFrame:
        """(cell_id, down_id)."""
        if self.how != "exact":
            try:
                return self._step("receivers", self.cells, lambda cells: routing.receivers_by_lowest(cells, self.grid))
            except Cancelled:
                raise
            except TerrainError:
                if self.how == "lowest":
                    raise
        return self.flood.select("cell_id", "down_id")

    @cached_property
    def flood(self) -> DataFrame:
        return self._step("flood", self.cells, lambda cells: routing.flood(cells, self.grid))

    @cached_property
    def tree(self) -> DataFrame:
        """(cell_id, down_id, acc)."""
        return self._step("accumulation", self.receivers, lambda receivers: streams.accumulation(receivers, self.grid))

    @cached_property
    def cell_strahler(self) -> DataFrame:
        return self._step("orders", self.tree, lambda tree: streams.strahler(tree, self.grid))

    def filled(self) -> DataFrame:
        return routing.filled_surface(self.cells, self.grid)

    def flow_paths(self, min_acc: int = MIN_ACC) -> DataFrame:
        """The flow path layer, kept for each threshold."""
        kept = self.__dict__.setdefault("_paths", {})
        if min_acc not in kept:
            kept[min_acc] = self._step("flow paths", self.tree, lambda tree: streams.flow_paths(tree, self.grid, min_acc))
        return kept[min_acc]

    def reaches(self, min_acc: int = MIN_ACC, paths: DataFrame | None = None) -> DataFrame:
        return streams.reaches(self.flow_paths(min_acc), self.grid, False) if paths is None else streams.reaches(paths, self.grid)

    def outlets(self, line: list[catchments.Point], min_acc: int = MIN_ACC) -> DataFrame:
        return catchments.line_crossing(self.flow_paths(min_acc), self.grid, line)

    def trace(self, x: float, y: float, min_acc: int = MIN_ACC) -> DataFrame:
        """Cells upstream of the flow path nearest to a point."""
        return catchments.upstream(self.tree, self.grid, catchments.nearest_segment(self.flow_paths(min_acc), self.grid, x, y))

    def assignment(self, min_cells: int, outlets: DataFrame | None = None) -> DataFrame:
        """(cell_id, outlet_id) of the whole grid, or of what drains through the outlets."""
        domain = None if outlets is None else cut(catchments.upstream(self.tree, self.grid, outlets))
        chosen = catchments.greedy_outlets(self.tree, self.grid, min_cells, domain)
        return catchments.assign(self.tree, self.grid, chosen, domain)

    def subcatchments(self, min_area_m2: float = MIN_AREA, outlets: DataFrame | None = None, min_acc: int = MIN_ACC, assigned: DataFrame | None = None) -> DataFrame:
        if not min_area_m2 > 0:
            raise TerrainError("the least area must be above 0")
        assigned = self.assignment(self.grid.min_cells(min_area_m2), outlets) if assigned is None else assigned
        return catchments.subcatchments(assigned, self.grid, self.cell_strahler, self.flow_paths(min_acc))
