"""The registered terrain queries. Grids come from the driver's tables; see talweg.sources.grid."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.engine import Terrain
from talweg.functions import geometry as G
from talweg.functions import geodesy, projections
from talweg.functions.lineage import cut
from talweg.operators import catchments, dissolve, masks, network, routing, spatial, streams
from talweg.plans.oracle import sql
from talweg.sources import catg
from talweg.sources import grid as grids
from talweg.sources.grid import Grid

MIN_ACC, MIN_CELLS = 10, 100
LINE = [(300.0, -60.0), (800.0, -63.0)]
MASK = [[(105.0, -12.0), (905.0, -8.0), (702.0, -93.0), (95.0, -71.0)]]
CLICK = (512.0, -47.0)

_made: dict[tuple, Terrain] = {}


def terrain(spark: SparkSession, sf_dir: str, name: str = "branching") -> Terrain:
    """The grid's Terrain; steps that several queries build on are written once for each session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        grid, cells = getattr(grids, name)(spark, sf_dir)
        _made[key] = Terrain(grid, cells, receivers="lowest" if name in ("branching", "valley") else "exact")
    return _made[key]


def forget(*keep: str) -> None:
    """Drops what the session's terrains have written, but for the steps named in keep: for timing a query by itself."""
    for t in _made.values():
        for name in [n for n in t.__dict__ if n.startswith("_") or n in ("cells", "receivers", "flood", "tree", "cell_strahler")]:
            if name not in keep:
                del t.__dict__[name]


def _once(t: Terrain, name: str, make) -> DataFrame:
    if name not in t.__dict__:
        t.__dict__[name] = cut(make())
    return t.__dict__[name]


def crossed(t: Terrain) -> DataFrame:
    return _once(t, "_crossed", lambda: catchments.line_crossing(t.flow_paths(MIN_ACC), t.grid, LINE))


def domain(t: Terrain) -> DataFrame:
    return _once(t, "_domain", lambda: catchments.upstream(t.tree, t.grid, crossed(t)))


def chosen(t: Terrain) -> DataFrame:
    return _once(t, "_chosen", lambda: catchments.greedy_outlets(t.tree, t.grid, MIN_CELLS, domain(t)))


def assigned(t: Terrain) -> DataFrame:
    return _once(t, "_assigned", lambda: catchments.assign(t.tree, t.grid, chosen(t), domain(t)))


def layer(t: Terrain) -> DataFrame:
    return _once(t, "_layer", lambda: catchments.subcatchments(assigned(t), t.grid, t.cell_strahler, t.flow_paths(MIN_ACC)))


def downstream(t: Terrain) -> DataFrame:
    return _once(t, "_downstream", lambda: network.downstream_map(assigned(t), t.tree))


def main_upstream(t: Terrain) -> DataFrame:
    return catchments.upstream(t.tree, t.grid, catchments.model_outlet(crossed(t)))




def dem_cells(s, d):
    g, cells = grids.branching(s, d)
    return cells.select("cell_id", "r", "c", F.round("z", 9).alias("z"), G.centre_x(g, F.col("cell_id")).alias("x"), G.centre_y(g, F.col("cell_id")).alias("y"))


def seeds(s, d):
    t = terrain(s, d)
    return routing.seeds(t.cells, t.grid).select("cell_id")


def neighbours(s, d):
    t = terrain(s, d)
    return routing.neighbours(t.cells, t.grid).select("cell_id", "nbr_id")


def receiver(s, d):
    t = terrain(s, d)
    return routing.receivers_by_lowest(t.cells, t.grid)


def filled(s, d):
    t = terrain(s, d, "pitted")
    return routing.filled_surface(t.cells, t.grid).select("cell_id", "filled")


def exact_flood(s, d):
    """Receivers of a surface with pits: they follow the order of the flood, which SQL cannot say; tests hold them against a scalar flood."""
    t = terrain(s, d, "pitted")
    return routing.flood(t.cells, t.grid).select("cell_id", "down_id", "filled", "pop_rank")


def accumulation(s, d):
    t = terrain(s, d)
    return streams.accumulation(routing.receivers_by_lowest(t.cells, t.grid, check=False), t.grid)


def flow_paths(s, d):
    return terrain(s, d).flow_paths(MIN_ACC)


def cell_strahler(s, d):
    t = terrain(s, d)
    return streams.strahler(t.tree, t.grid)


def stream_strahler(s, d):
    t = terrain(s, d)
    return streams.stream_strahler(streams.displayed(t.tree, MIN_ACC), t.grid)


def reaches(s, d):
    return terrain(s, d).reaches(MIN_ACC)


def upstream_trace(s, d):
    return main_upstream(terrain(s, d))


def trace_count(s, d):
    return main_upstream(terrain(s, d)).agg(F.count(F.lit(1)).alias("n_cells"))


def line_crossing(s, d):
    return catchments.line_crossing(terrain(s, d).flow_paths(MIN_ACC), terrain(s, d).grid, LINE)


def nearest_segment(s, d):
    t = terrain(s, d)
    return catchments.nearest_segment(t.flow_paths(MIN_ACC), t.grid, *CLICK).select("cell_id", F.round("distance", 6).alias("distance"))


def _drawn(s, d) -> DataFrame:
    """A line of three points and a point for each customer, spread over the grid and its surroundings."""
    k, b = F.col("c_custkey").cast("long"), F.floor(F.abs("c_acctbal")).cast("long")
    x, y = F.pmod(k * 37, F.lit(1290)) - 19.75, -(F.pmod(k * 91, F.lit(1240)) - 19.75)
    p = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    bend = p(F.pmod(b, F.lit(61)) - 30, F.pmod(b, F.lit(47)) - 23)
    line = F.array(p(F.lit(0), F.lit(0)), bend, p(F.pmod(b, F.lit(131)) - 65, F.pmod(b, F.lit(97)) - 48))
    return s.read.parquet(f"{d}/customer.parquet").select(k.alias("line_id"), k.alias("point_id"), line.alias("points"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def outlet_lines(s, d):
    """What each customer's line meets."""
    t = terrain(s, d)
    return spatial.lines_crossing(t.flow_paths(MIN_ACC), t.grid, _drawn(s, d))


def outlets_of_lines(s, d):
    return spatial.outlets_of_lines(outlet_lines(s, d))


def nearest_segments(s, d):
    """The three segments nearest to each customer's point."""
    t = terrain(s, d)
    return spatial.nearest_segments(t.flow_paths(MIN_ACC), t.grid, _drawn(s, d), 3).select("point_id", F.col("rank").cast("long").alias("rank"), "cell_id", F.round("distance", 6).alias("distance"))


def model_outlet(s, d):
    return catchments.model_outlet(crossed(terrain(s, d)))


def min_cells(s, d):
    """Least cells of each order's price read as an area."""
    t = terrain(s, d)
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", t.grid.min_cells_of(F.col("o_totalprice") - 1000.0).alias("min_cells"))


def greedy_outlets(s, d):
    t = terrain(s, d)
    return catchments.greedy_outlets(t.tree, t.grid, MIN_CELLS)


def assignment(s, d):
    t = terrain(s, d)
    whole = _once(t, "_whole", lambda: catchments.greedy_outlets(t.tree, t.grid, MIN_CELLS))
    return catchments.assign(t.tree, t.grid, whole)


def subcatchments(s, d):
    t = terrain(s, d)
    return catchments.subcatchments(assigned(t), t.grid, t.cell_strahler, t.flow_paths(MIN_ACC))


def subcatchment_totals(s, d):
    t = terrain(s, d)
    return catchments.totals(layer(t), t.grid, t.grid.rows * t.grid.cols, MIN_CELLS)


def restricted_flow_paths(s, d):
    t = terrain(s, d)
    return catchments.restrict_paths(t.flow_paths(MIN_ACC), assigned(t))


def restricted_reaches(s, d):
    t = terrain(s, d)
    return streams.reaches(catchments.restrict_paths(t.flow_paths(MIN_ACC), assigned(t)), t.grid)


def highlight(s, d):
    t = terrain(s, d)
    return catchments.highlight(main_upstream(t), t.flow_paths(MIN_ACC))


def selection_normalised(s, d):
    t = terrain(s, d)
    some = t.flow_paths(MIN_ACC).where("cell_id % 7 = 0").select("cell_id")
    return catchments.normalise_selection(t.tree, t.grid, some)


def downstream_map(s, d):
    t = terrain(s, d)
    return _sinks_marked(network.downstream_map(assigned(t), t.tree))


def depth_order(s, d):
    t = terrain(s, d)
    return _sinks_marked(network.depth_order(downstream(t), t.tree))


def _sinks_marked(links: DataFrame) -> DataFrame:
    """A sink's ds_id as -1."""
    return links.withColumn("ds_id", F.coalesce("ds_id", F.lit(-1)))


def terminal_count(s, d):
    return downstream(terrain(s, d)).agg(F.count_if(F.col("ds_id").isNull()).alias("n_terminals"))


def receivers_set(s, d):
    return network.receivers_set(downstream(terrain(s, d)))


def mask_quality(s, d):
    t = terrain(s, d)
    return masks.mask_quality(_holed(t), t.grid, MASK)


def mask_filter(s, d):
    t = terrain(s, d)
    return masks.mask_filter(_holed(t), t.grid, MASK).select("cell_id")


def _geographic_mask(s, d) -> DataFrame:
    """A layer of triangles around some customers' places, in longitude and latitude; the grid's corner is put on a place in zone 55."""
    k, b = F.col("c_custkey").cast("long"), F.floor(F.abs("c_acctbal")).cast("long")
    x, y = F.pmod(k * 37, F.lit(1250)).cast("double") + 0.25, -(F.pmod(k * 91, F.lit(1200)).cast("double") + 0.75)
    size = F.pmod(b, F.lit(40)).cast("double") + 5.5
    p = lambda dx, dy: F.struct((x + 300_000 + dx).alias("x"), (y + 5_800_000 + dy).alias("y"))
    triangles = s.read.parquet(f"{d}/customer.parquet").where(k % 10 == 0).select(k.alias("polygon_id"), F.array(p(-size, -size), p(size, F.lit(-3.25)), p(F.lit(1.5), size)).alias("points"))
    return projections.reproject_points(triangles, "EPSG:28355", "EPSG:4283")


def mask_of_layer(s, d):
    """Cells that a layer of polygons in another reference system touches."""
    t = terrain(s, d)
    grid = dataclasses.replace(t.grid, x0=300_000.0, y0=5_800_000.0, crs="EPSG:28355")
    return masks.in_mask(t.cells.select("cell_id", "z"), grid, masks.mask_in_grid(grid, _geographic_mask(s, d), "EPSG:4283")).select("cell_id")


def nodata_cells(s, d):
    t = terrain(s, d)
    return masks.nodata_cells(_holed(t), t.grid, MASK)


def _holed(t: Terrain) -> DataFrame:
    """The grid's cells, every 11th without data."""
    return t.all_cells.select("cell_id", F.when(F.col("cell_id") % 11 != 0, F.col("z")).alias("z"))


def centroids(s, d):
    t = terrain(s, d)
    return catchments.centroids(assigned(t), t.grid)


def display_scale(s, d):
    t = terrain(s, d)
    return network.display_scale(catchments.centroids(assigned(t), t.grid).withColumnRenamed("outlet_id", "node_id")).select("node_id", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


def impervious_norm(s, d):
    raw = F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal") / 60.0)
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.round(G.impervious_fraction(raw, 0.25), 9).alias("fraction"))


def drainage_order(s, d):
    """Distinct stream orders and their display style."""
    return streams.style(terrain(s, d).flow_paths(MIN_ACC)).select("strahler", "red", "green", "blue", F.round("width", 6).alias("width"))


def group_sizes(s, d):
    """Cells and area of the selected groups."""
    t = terrain(s, d)
    return catchments.selection_summary(selection_normalised(s, d), t.grid)


def outlines(s, d):
    """Area of each subcatchment's traced outline, and how many cell sides it had before straight runs were joined."""
    t = terrain(s, d)
    groups = assigned(t).withColumnRenamed("outlet_id", "group_id")
    sides = dissolve.boundary_edges(groups, t.grid).groupBy("group_id").agg(F.count(F.lit(1)).alias("sides"))
    return dissolve.dissolve(groups, t.grid).join(sides, "group_id").select(F.col("group_id").alias("outlet_id"), F.round("area", 3).alias("area"), "sides")


def outlet_paths(s, d):
    """Each outlet's way to the next: where it leads (-1: out), its cells and length."""
    t = terrain(s, d)
    ways = network.outlet_paths(assigned(t), t.tree, t.grid)
    steps = F.transform(F.sequence(F.lit(1), F.size("cells") - 1), lambda i: G.segment_length(t.grid, F.element_at("cells", i), F.element_at("cells", i + 1)))
    length = F.when(F.size("cells") > 1, F.aggregate(steps, F.lit(0.0), lambda a, v: a + v)).otherwise(0.0)
    return ways.select("outlet_id", F.coalesce("ds_id", F.lit(-1)).alias("ds_id"), F.size("cells").cast("long").alias("n_cells"), F.round(length, 3).alias("length_m"))


def _geographic(t: Terrain) -> Grid:
    """The terrain's grid as one of 0.3 arc seconds."""
    return dataclasses.replace(t.grid, x0=144.0, dx=1 / 12_000, y0=-37.0, dy=-1 / 12_000, crs="EPSG:7844")


def ellipsoid_areas(s, d):
    """Areas of subcatchments on the ellipsoid, on a grid of angles."""
    t = terrain(s, d)
    return geodesy.areas(assigned(t).withColumnRenamed("outlet_id", "group_id"), _geographic(t)).select(F.col("group_id").alias("outlet_id"), F.round("area_m2", 4).alias("area_m2"))


def ellipsoid_lengths(s, d):
    """Lengths of flow paths on the ellipsoid, by stream order."""
    t = terrain(s, d)
    return geodesy.with_length(t.flow_paths(MIN_ACC), _geographic(t)).groupBy("strahler").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length_m"), 4).alias("length_m"))


def _catg_lines(s, d) -> DataFrame:
    """The nations as a node-link file: each flows to the next one, the last is the outlet; every third reach has a name."""
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("double").alias("v"))
    last = F.col("k") == 24
    node = F.format_string("C %6d%15.3f%15.3f%15.3f %d %d%6d N%-20d%15.3f%15.3f%3d  0  0", F.col("k") + 1, F.col("k") * 1.5, 90 - F.col("v"), F.lit(1.0), (~last).cast("int"), last.cast("int"), F.when(last, 0).otherwise(F.col("k") + 2), "k", F.col("v") / 8 + 0.5, F.col("v") / 16, F.when(last, 72).otherwise(0))
    reach = F.format_string("C %6d %-20s%6d%6d%15d%2d 0%15.3f%15.3f%6d  0", F.col("k") + 1, F.when(F.col("k") % 3 == 0, F.concat(F.lit("R"), F.col("k"))).otherwise(""), F.col("k") + 1, F.col("k") + 2, F.lit(0), F.lit(1), F.col("k") * 0.25, F.lit(0.125), F.lit(1))
    mid = [F.format_string("C %15.3f", F.col("k") * 1.5 + 0.75), F.format_string("C %15.3f", 90 - F.col("v"))]
    fixed = lambda pos, line: s.range(1).select(F.lit(pos).cast("long").alias("pos"), F.lit(line).alias("line"))
    parts = [fixed(0, "C #NODES"), fixed(1, "C     25"), n.select((F.col("k") * 2 + 2).alias("pos"), node.alias("line")), n.select((F.col("k") * 2 + 3).alias("pos"), F.lit("C ").alias("line")), fixed(1000, "C #REACHES"), fixed(1001, "C     25")]
    parts += [n.select((F.col("k") * 3 + 1002 + i).alias("pos"), x.alias("line")) for i, x in enumerate([reach, *mid])] + [fixed(2000, "C END RORB_GE")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit("nations").alias("file"), "pos", "line")


def catg_nodes(s, d):
    return catg.from_lines(_catg_lines(s, d))[0].select("node_id", "name", "downstream", "is_basin", "is_outlet", "area_km2", "imperv_frac", "print_code", "x", "y")


def catg_links(s, d):
    """Links between known nodes; the last reach leads to none and is left out."""
    links = catg.from_lines(_catg_lines(s, d))[1]
    return links.select("reach_id", "name", "us_node", "ds_node", "reach_type", "length_km", "slope", F.element_at("line", 2)["x"].alias("mid_x"), F.size("line").cast("long").alias("n_points"))


QUERIES = {
    f.__name__: f
    for f in (
        dem_cells, seeds, neighbours, receiver, filled, exact_flood, accumulation, flow_paths, cell_strahler, stream_strahler, reaches,
        upstream_trace, trace_count, line_crossing, outlet_lines, outlets_of_lines, nearest_segment, nearest_segments, model_outlet, min_cells, greedy_outlets, assignment, subcatchments,
        subcatchment_totals, restricted_flow_paths, restricted_reaches, highlight, selection_normalised, group_sizes, downstream_map, depth_order,
        terminal_count, receivers_set, mask_quality, mask_filter, mask_of_layer, nodata_cells, centroids, display_scale, impervious_norm, drainage_order, outlines, ellipsoid_areas, ellipsoid_lengths, outlet_paths, catg_nodes, catg_links,
    )
}

_X, _Y = "((cell_id%125)+0.5)*10.0", "((cell_id//125)+0.5)*-10.0"


def _mask_sql() -> str:
    """Cells that the polygon touches: centre inside by the even-odd rule, or an edge that meets the cell's box."""
    ring = masks.closed(MASK[0])
    inside, touch = [], []
    for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
        if y0 != y1:
            inside.append(f"CASE WHEN (({y0!r}>y)<>({y1!r}>y)) AND x<{x0!r}+(y-({y0!r}))*{(x1 - x0) / (y1 - y0)!r} THEN 1 ELSE 0 END")
        box = f"xa<={max(x0, x1)!r} AND xb>={min(x0, x1)!r} AND ya<={max(y0, y1)!r} AND yb>={min(y0, y1)!r}"
        orient = lambda px, py: f"(({x1 - x0!r})*({py}-({y0!r}))-({y1 - y0!r})*({px}-({x0!r})))"
        corners = [orient("xa", "ya"), orient("xb", "ya"), orient("xa", "yb"), orient("xb", "yb")]
        touch.append(f"({box} AND NOT ({' AND '.join(c + '>0' for c in corners)}) AND NOT ({' AND '.join(c + '<0' for c in corners)}))")
    return f"""SELECT cell_id, CASE WHEN cell_id%11<>0 THEN z END AS z FROM (
  SELECT cell_id, z, {_X} AS x, {_Y} AS y, (cell_id%125)*10.0 AS xa, (cell_id%125+1)*10.0 AS xb, (cell_id//125+1)*-10.0 AS ya, (cell_id//125)*-10.0 AS yb FROM cells) q
WHERE ({' + '.join(inside)})%2=1 OR {' OR '.join(touch)}"""


def _nearest_sql() -> str:
    x, y = CLICK
    return sql(
        f"""SELECT arg_min(cell_id, (round(d,12), cell_id)) AS cell_id, round(min(d),6) AS distance FROM (
  SELECT cell_id, sqrt(power({x}-(ax+t*(bx-ax)),2)+power({y}-(ay+t*(bw-ay)),2)) AS d FROM (
    SELECT *, greatest(0.0,least(1.0,(({x}-ax)*(bx-ax)+({y}-ay)*(bw-ay))/(power(bx-ax,2)+power(bw-ay,2)))) AS t FROM seg))""",
        "crossed",
    )


_SEGMENT = "SELECT cell_id, acc_cells, (cell_id%125+0.5)*10.0::DOUBLE ax, (cell_id//125+0.5)*-10.0::DOUBLE ay, (down_id%125+0.5)*10.0::DOUBLE bx, (down_id//125+0.5)*-10.0::DOUBLE bw FROM paths"
_DRAWN = """SELECT k, x AS x0, y AS y0, x+b%61-30 AS x1, y+b%47-23 AS y1, x+b%131-65 AS x2, y+b%97-48 AS y2
  FROM (SELECT c_custkey AS k, floor(abs(c_acctbal))::BIGINT AS b, ((c_custkey*37)%1290)::DOUBLE-19.75 AS x, -(((c_custkey*91)%1240)::DOUBLE-19.75) AS y FROM customer)"""
_MET = sql(
    f""", seg AS ({_SEGMENT}), drawn AS ({_DRAWN}), piece AS (SELECT k, x0, y0, x1, y1 FROM drawn UNION ALL SELECT k, x1, y1, x2, y2 FROM drawn),
side AS (SELECT k, cell_id, acc_cells, (x1-x0)*(ay-y0)-(y1-y0)*(ax-x0) d1, (x1-x0)*(bw-y0)-(y1-y0)*(bx-x0) d2, (bx-ax)*(y0-ay)-(bw-ay)*(x0-ax) d3, (bx-ax)*(y1-ay)-(bw-ay)*(x1-ax) d4 FROM piece JOIN seg
  ON greatest(ax,bx)>=least(x0,x1) AND least(ax,bx)<=greatest(x0,x1) AND greatest(ay,bw)>=least(y0,y1) AND least(ay,bw)<=greatest(y0,y1)),
met AS (SELECT DISTINCT k AS line_id, cell_id, acc_cells FROM side WHERE NOT ((d1>0 AND d2>0) OR (d1<0 AND d2<0) OR (d3>0 AND d4>0) OR (d3<0 AND d4<0)))
""",
    "paths",
).replace("\n, seg", ",\nseg")
_E2 = geodesy.eccentricity_squared((6378137.0, 298.257222101))
_E = _E2**0.5


def _authalic(lat: str) -> str:
    """Area between the equator and a latitude in degrees, for a turn of one radian."""
    return f"(6378137.0::DOUBLE*6378137.0::DOUBLE/2*{1 - _E2!r}::DOUBLE*(sin(radians({lat}))/(1-{_E2!r}*power(sin(radians({lat})),2))+ln((1+{_E!r}*sin(radians({lat})))/(1-{_E!r}*sin(radians({lat}))))/{2 * _E!r}))"


_STYLE = "lo AS (SELECT min(strahler) a, max(strahler) b FROM paths)"
ORACLES = {
    "dem_cells": sql(f"SELECT cell_id, r, c, round(z,9) AS z, {_X} AS x, {_Y} AS y FROM cells"),
    "seeds": sql("SELECT cell_id FROM seed", "seed"),
    "neighbours": sql("SELECT cell_id, nbr_id FROM nbr", "nbr"),
    "receiver": sql("SELECT cell_id, down_id FROM rcv", "rcv"),
    "filled": sql(
        """, fill(cell_id, f) USING KEY (cell_id) AS (
  SELECT c.cell_id, CASE WHEN s.cell_id IS NULL THEN 1e300::DOUBLE ELSE c.z END FROM cells c LEFT JOIN seed s USING (cell_id)
  UNION
  SELECT q.cell_id, q.f FROM (SELECT n.nbr_id AS cell_id, greatest(any_value(n.nbr_z), min(t.f)) AS f FROM recurring.fill t JOIN nbr n USING (cell_id) GROUP BY 1) q
  JOIN recurring.fill cur USING (cell_id) WHERE q.f<cur.f)
SELECT cell_id, f AS filled FROM fill""",
        "seed",
        grid="pitted",
    ).replace("\n, fill", ",\nfill"),
    "accumulation": sql("SELECT cell_id, down_id, acc FROM acc", "acc"),
    "flow_paths": sql("SELECT * FROM paths", "paths"),
    "cell_strahler": sql("SELECT cell_id, s::INT AS strahler FROM ord", "ord"),
    "stream_strahler": sql("SELECT cell_id, s::INT AS strahler FROM sord", "sord"),
    "reaches": sql("SELECT * FROM reach", "reach"),
    "upstream_trace": sql("SELECT cell_id FROM up", "up"),
    "trace_count": sql("SELECT count(*) AS n_cells FROM up", "up"),
    "line_crossing": sql("SELECT cell_id, acc_cells FROM crossed", "crossed"),
    "nearest_segment": _nearest_sql(),
    "outlet_lines": f"{_MET}SELECT line_id, cell_id, acc_cells FROM met",
    "outlets_of_lines": f"{_MET}SELECT line_id, count(*) AS n_crossed, arg_max(cell_id, (acc_cells, cell_id)) AS cell_id, max(acc_cells) AS acc_cells FROM met GROUP BY 1",
    "nearest_segments": sql(
        f""", seg AS ({_SEGMENT}), drawn AS ({_DRAWN}),
far AS (SELECT k, cell_id, sqrt(power(x0-(ax+t*(bx-ax)),2)+power(y0-(ay+t*(bw-ay)),2)) AS d FROM (
  SELECT *, greatest(0.0,least(1.0,((x0-ax)*(bx-ax)+(y0-ay)*(bw-ay))/(power(bx-ax,2)+power(bw-ay,2)))) AS t FROM drawn, seg))
SELECT k AS point_id, rank, cell_id, round(d,6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(d,9), cell_id) AS rank FROM far) WHERE rank<=3""",
        "paths",
    ).replace("\n, seg", ",\nseg"),
    "model_outlet": sql("SELECT cell_id, acc_cells FROM main", "main"),
    "min_cells": "SELECT o_orderkey, greatest(1, ceil((o_totalprice-1000.0)/100.0))::BIGINT AS min_cells FROM orders",
    "greedy_outlets": sql("SELECT cell_id, open_cells FROM greedy", "greedy"),
    "assignment": sql("SELECT cell_id, outlet_id FROM asg", "asg"),
    "subcatchments": sql("SELECT * FROM subs", "subs"),
    "subcatchment_totals": sql(
        "SELECT count(*) AS n, sum(cell_count)::BIGINT AS cells, round(sum(area_m2)/1e4,2) AS total_ha_2, round(sum(area_m2)/1e4,3) AS total_ha_3, (SELECT count(*)//100 FROM cells)::BIGINT AS most FROM subs", "subs"
    ),
    "restricted_flow_paths": sql("SELECT * FROM paths WHERE cell_id IN (SELECT cell_id FROM dasg)", "dasg"),
    "restricted_reaches": sql("SELECT * FROM rreach", "rreach"),
    "outlines": sql(
        """SELECT outlet_id, count(*)*100.0 AS area, sum(4-k)::BIGINT AS sides FROM (
  SELECT a.outlet_id, a.cell_id, count(b.cell_id) AS k FROM dasg a LEFT JOIN dasg b ON b.outlet_id=a.outlet_id AND ((b.cell_id=a.cell_id-125 OR b.cell_id=a.cell_id+125) OR (b.cell_id=a.cell_id+1 AND a.cell_id%125<124) OR (b.cell_id=a.cell_id-1 AND a.cell_id%125>0)) GROUP BY 1,2) GROUP BY 1""",
        "dasg",
    ),
    "ellipsoid_areas": sql(f"SELECT outlet_id, round(sum(radians(1/12000.0::DOUBLE)*({_authalic('-37-(cell_id//125)/12000.0::DOUBLE')}-{_authalic('-37-(cell_id//125+1)/12000.0::DOUBLE')})),4) AS area_m2 FROM dasg GROUP BY 1", "dasg"),
    "ellipsoid_lengths": sql(
        f"""SELECT strahler, count(*) AS n, round(sum(sqrt(power(m*radians(dr/12000.0::DOUBLE),2)+power(n*cos(lat)*radians(dc/12000.0::DOUBLE),2))),4) AS length_m FROM (
  SELECT *, 6378137.0::DOUBLE*{1 - _E2!r}::DOUBLE/power(1-{_E2!r}*power(sin(lat),2),1.5) AS m, 6378137.0::DOUBLE/sqrt(1-{_E2!r}*power(sin(lat),2)) AS n FROM (
    SELECT strahler, down_id//125-cell_id//125 AS dr, down_id%125-cell_id%125 AS dc, radians(-37-((down_id//125+cell_id//125)/2.0::DOUBLE+0.5)/12000.0::DOUBLE) AS lat FROM paths)) GROUP BY 1""",
        "paths",
    ),
    "outlet_paths": sql(
        """SELECT g.cell_id AS outlet_id, coalesce(max(CASE WHEN e.cell_id IN (SELECT cell_id FROM dgreedy) THEN e.cell_id END),-1) AS ds_id, coalesce(max(e.n),0)::BIGINT+1 AS n_cells, round(coalesce(max(e.len),0.0),3) AS length_m
FROM dgreedy g LEFT JOIN way e ON e.outlet_id=g.cell_id GROUP BY 1""",
        "way",
    ),
    "catg_nodes": """SELECT (n_nationkey+1)::VARCHAR AS node_id, 'N'||n_nationkey AS name, CASE WHEN n_nationkey=24 THEN 0 ELSE n_nationkey+2 END::VARCHAR AS downstream, CASE WHEN n_nationkey=24 THEN 0 ELSE 1 END::INT AS is_basin,
  CASE WHEN n_nationkey=24 THEN 1 ELSE 0 END::INT AS is_outlet, round(n_regionkey/8.0+0.5,3) AS area_km2, round(n_regionkey/16.0+1e-9,3) AS imperv_frac, CASE WHEN n_nationkey=24 THEN 72 ELSE 0 END::INT AS print_code,
  n_nationkey*1.5::DOUBLE AS x, (90-n_regionkey)::DOUBLE AS y FROM nation""",
    "catg_links": """SELECT (n_nationkey+1)::VARCHAR AS reach_id, CASE WHEN n_nationkey%3=0 THEN 'R'||n_nationkey ELSE '' END AS name, (n_nationkey+1)::VARCHAR AS us_node, (n_nationkey+2)::VARCHAR AS ds_node, 1::INT AS reach_type,
  n_nationkey*0.25::DOUBLE AS length_km, 0.125::DOUBLE AS slope, n_nationkey*1.5::DOUBLE+0.75 AS mid_x, 3::BIGINT AS n_points FROM nation WHERE n_nationkey<24""",
    "highlight": sql("SELECT cell_id, acc_cells, strahler FROM paths WHERE cell_id IN (SELECT cell_id FROM up)", "up", "paths"),
    "selection_normalised": sql(
        "SELECT p.cell_id AS group_id, a.up AS cell_id FROM paths p JOIN anc a USING (cell_id) WHERE p.cell_id%7=0 AND NOT EXISTS (SELECT 1 FROM paths q JOIN anc b ON b.cell_id=q.cell_id WHERE q.cell_id%7=0 AND b.up=p.cell_id AND q.cell_id<>p.cell_id)", "paths", "anc"
    ),
    "group_sizes": sql(
        """SELECT count(DISTINCT group_id) AS n_groups, count(DISTINCT cell_id) AS n_cells, count(DISTINCT cell_id)*100.0 AS area_m2 FROM (
  SELECT p.cell_id AS group_id, a.up AS cell_id FROM paths p JOIN anc a USING (cell_id) WHERE p.cell_id%7=0 AND NOT EXISTS (SELECT 1 FROM paths q JOIN anc b ON b.cell_id=q.cell_id WHERE q.cell_id%7=0 AND b.up=p.cell_id AND q.cell_id<>p.cell_id))""",
        "paths",
        "anc",
    ),
    "downstream_map": sql("SELECT outlet_id, coalesce(ds_id,-1) AS ds_id FROM down", "down"),
    "depth_order": sql("SELECT outlet_id, coalesce(ds_id,-1) AS ds_id, acc, depth, row_number() OVER (ORDER BY depth DESC, acc, outlet_id) AS position FROM depth JOIN down USING (outlet_id) JOIN acc ON acc.cell_id=outlet_id", "depth"),
    "terminal_count": sql("SELECT count(*) FILTER (WHERE ds_id IS NULL) AS n_terminals FROM down", "down"),
    "receivers_set": sql("SELECT DISTINCT ds_id AS outlet_id FROM down WHERE ds_id IS NOT NULL", "down"),
    "mask_quality": sql(f"SELECT true AS has_mask, count(*) AS mask_cells, count(z) AS valid_cells, count(*)-count(z) AS nodata_cells FROM ({_mask_sql()})"),
    "mask_filter": sql(f"SELECT cell_id FROM ({_mask_sql()}) WHERE z IS NOT NULL"),
    "mask_of_layer": sql(
        f""", tri AS (SELECT c_custkey AS k, ((c_custkey*37)%1250)::DOUBLE+0.25 AS x, -(((c_custkey*91)%1200)::DOUBLE+0.75) AS y, (floor(abs(c_acctbal))::BIGINT%40)::DOUBLE+5.5 AS s FROM customer WHERE c_custkey%10=0),
edge AS (SELECT k, x-s AS x0, y-s AS y0, x+s AS x1, y-3.25 AS y1 FROM tri UNION ALL SELECT k, x+s, y-3.25, x+1.5, y+s FROM tri UNION ALL SELECT k, x+1.5, y+s, x-s, y-s FROM tri),
box AS (SELECT cell_id, (c+0.5)*10.0::DOUBLE AS cx, -(r+0.5)*10.0::DOUBLE AS cy, c*10.0::DOUBLE AS xa, (c+1)*10.0::DOUBLE AS xb, -(r+1)*10.0::DOUBLE AS ya, -r*10.0::DOUBLE AS yb FROM cells),
met AS (SELECT k, cell_id, (y0>cy)<>(y1>cy) AND cx<x0+(cy-y0)*((x1-x0)/(y1-y0)) AS crossed, xa<=greatest(x0,x1) AND xb>=least(x0,x1) AND ya<=greatest(y0,y1) AND yb>=least(y0,y1)
    AND NOT (least((x1-x0)*(ya-y0)-(y1-y0)*(xa-x0),(x1-x0)*(ya-y0)-(y1-y0)*(xb-x0),(x1-x0)*(yb-y0)-(y1-y0)*(xa-x0),(x1-x0)*(yb-y0)-(y1-y0)*(xb-x0))>0
      OR greatest((x1-x0)*(ya-y0)-(y1-y0)*(xa-x0),(x1-x0)*(ya-y0)-(y1-y0)*(xb-x0),(x1-x0)*(yb-y0)-(y1-y0)*(xa-x0),(x1-x0)*(yb-y0)-(y1-y0)*(xb-x0))<0) AS touched
  FROM edge JOIN box ON ya<=greatest(y0,y1) AND yb>=least(y0,y1))
SELECT DISTINCT cell_id FROM (SELECT cell_id, k FROM met GROUP BY 1,2 HAVING bool_or(touched) OR count(*) FILTER (crossed)%2=1)"""
    ).replace("\n, tri", ",\ntri"),
    "nodata_cells": sql(f"SELECT cell_id FROM ({_mask_sql()}) WHERE z IS NULL"),
    "centroids": sql(f"SELECT outlet_id, round(avg({_X}),6) AS x, round(avg({_Y}),6) AS y FROM dasg GROUP BY 1", "dasg"),
    "display_scale": sql(
        f""", cen AS (SELECT outlet_id AS node_id, round(avg({_X}),6) AS x, round(avg({_Y}),6) AS y FROM dasg GROUP BY 1), ext AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM cen)
SELECT node_id, round((x-x0)/greatest(x1-x0,1.0)*90+2.5,6) AS sx, round((y-y0)/greatest(y1-y0,1.0)*90+2.5,6) AS sy FROM cen, ext""",
        "dasg",
    ).replace("\n, cen", ",\ncen"),
    "impervious_norm": "SELECT c_custkey, round(CASE WHEN v IS NULL THEN 0.25 WHEN v<0 THEN 0.0 WHEN v>1 AND v<=100 THEN v/100.0 WHEN v>1 THEN 1.0 ELSE v END,9) AS fraction FROM (SELECT c_custkey, CASE WHEN c_custkey%13<>0 THEN c_acctbal/60.0 END AS v FROM customer)",
    "drainage_order": sql(
        f""", {_STYLE} SELECT strahler, trunc(190+(0-190)*t)::INT AS red, trunc(222+(32-222)*t)::INT AS green, trunc(246+(95-246)*t)::INT AS blue, round(0.25+least(strahler,12)*0.12,6) AS width
FROM (SELECT DISTINCT strahler, CASE WHEN a=b THEN 0.0 ELSE (strahler-a)/(b-a) END AS t FROM paths, lo)""",
        "paths",
    ).replace("\n, lo", ",\nlo"),
}
