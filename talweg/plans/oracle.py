"""DuckDB SQL for the terrain queries, put together from named parts."""

from __future__ import annotations

# Each part: (parts it needs, text). The grids are the ones of talweg.sources.grid.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "steps": ((), "steps AS (SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) t(dr,dc))"),
    "branching": ((), "cells AS (SELECT o_orderkey AS cell_id, o_orderkey//125 AS r, o_orderkey%125 AS c, 10.0::DOUBLE*(o_orderkey//125)+9.9::DOUBLE*o_totalprice/500000.0::DOUBLE AS z FROM orders)"),
    "pitted": ((), "cells AS (SELECT c_custkey AS cell_id, c_custkey//25 AS r, c_custkey%25 AS c, c_acctbal AS z FROM customer)"),
    "nbr": (("steps",), "nbr AS (SELECT a.cell_id, b.cell_id AS nbr_id, b.z AS nbr_z FROM cells a CROSS JOIN steps s JOIN cells b ON b.r=a.r+s.dr AND b.c=a.c+s.dc)"),
    "seed": (("nbr",), "seed AS (SELECT c.cell_id, c.z FROM cells c LEFT JOIN (SELECT cell_id, count(*) n FROM nbr GROUP BY 1) k USING (cell_id) WHERE coalesce(n,0)<8)"),
    "rcv": (("seed",), "rcv AS MATERIALIZED (SELECT n.cell_id, CASE WHEN s.cell_id IS NOT NULL THEN -1 ELSE n.best END::BIGINT AS down_id FROM (SELECT cell_id, arg_min(nbr_id, nbr_z) best FROM nbr GROUP BY 1) n LEFT JOIN seed s USING (cell_id))"),
    "anc": (("rcv",), "anc AS (SELECT cell_id, cell_id AS up FROM rcv UNION ALL SELECT r.down_id, a.up FROM anc a JOIN rcv r ON r.cell_id=a.cell_id WHERE r.down_id>=0)"),
    "acc": (("anc",), "acc AS MATERIALIZED (SELECT r.cell_id, r.down_id, a.n::BIGINT AS acc FROM rcv r JOIN (SELECT cell_id, count(*) n FROM anc GROUP BY 1) a USING (cell_id))"),
    "shown": (("acc",), "shown AS MATERIALIZED (SELECT cell_id, down_id, acc FROM acc WHERE down_id>=0 AND acc>=10)"),
    # the outlet line of the queries: from (300, -60) to (800, -63)
    "crossed": (
        ("paths",),
        """seg AS (SELECT cell_id, acc_cells, (cell_id%125+0.5)*10.0 ax, (cell_id//125+0.5)*-10.0 ay, (down_id%125+0.5)*10.0 bx, (down_id//125+0.5)*-10.0 bw FROM paths),
orient AS (SELECT *, (500.0)*(ay+60.0)-(-3.0)*(ax-300.0) d1, (500.0)*(bw+60.0)-(-3.0)*(bx-300.0) d2, (bx-ax)*(-60.0-ay)-(bw-ay)*(300.0-ax) d3, (bx-ax)*(-63.0-ay)-(bw-ay)*(800.0-ax) d4 FROM seg),
crossed AS MATERIALIZED (SELECT cell_id, acc_cells FROM orient WHERE greatest(ax,bx)>=300 AND least(ax,bx)<=800 AND greatest(ay,bw)>=-63 AND least(ay,bw)<=-60
  AND NOT ((d1>0 AND d2>0) OR (d1<0 AND d2<0) OR (d3>0 AND d4>0) OR (d3<0 AND d4<0)))""",
    ),
    "dom": (("crossed", "anc"), "dom AS MATERIALIZED (SELECT DISTINCT a.up AS cell_id FROM anc a JOIN crossed x ON x.cell_id=a.cell_id)"),
    "main": (("crossed",), "main AS (SELECT arg_max(cell_id, (acc_cells, cell_id)) AS cell_id, max(acc_cells) AS acc_cells FROM crossed)"),
    "up": (("main", "anc"), "up AS MATERIALIZED (SELECT a.up AS cell_id FROM anc a JOIN main USING (cell_id))"),
}


def _orders(name: str, inside: str) -> str:
    """Strahler orders of the relation ``inside`` (cell_id, down_id): a fixpoint of largest order and how often it occurs."""
    return f"""{name}(cell_id, s) USING KEY (cell_id) AS (
  SELECT cell_id, 1 FROM {inside}
  UNION
  SELECT q.cell_id, q.n FROM (
    SELECT g.down_id AS cell_id, max(g.top + CASE WHEN g.k>1 THEN 1 ELSE 0 END) AS n FROM (
      SELECT a.down_id, max(t.s) AS top, count(*) FILTER (WHERE t.s=m.mx) AS k
      FROM recurring.{name} t JOIN {inside} a USING (cell_id) JOIN (SELECT a2.down_id, max(t2.s) mx FROM recurring.{name} t2 JOIN {inside} a2 USING (cell_id) GROUP BY 1) m ON m.down_id=a.down_id
      WHERE a.down_id>=0 GROUP BY 1) g GROUP BY 1) q
  JOIN recurring.{name} cur USING (cell_id) WHERE q.n<>cur.s)"""


def _reach_parts(mark: str, shown: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Parts that lead from displayed cells to paths and reaches; mark sets their names apart."""
    length = "sqrt(power(10.0*(h.down_id%125-h.cell_id%125),2)+power(10.0*(h.down_id//125-h.cell_id//125),2))"
    return {
        f"{mark}sord": ((shown,), _orders(f"{mark}sord", shown)),
        f"{mark}paths": (
            (f"{mark}sord",),
            f"""{mark}paths AS MATERIALIZED (SELECT h.cell_id, (h.cell_id//125)::INT AS "row", (h.cell_id%125)::INT AS col, h.down_id, h.acc AS acc_cells, o.s::INT AS strahler, round({length},2) AS length_m
  FROM {shown} h JOIN {mark}sord o USING (cell_id))""",
        ),
        f"{mark}merge": (
            (f"{mark}paths",),
            f"""{mark}kin AS (SELECT down_id, strahler, count(*) k FROM {mark}paths GROUP BY 1,2),
{mark}mrg AS MATERIALIZED (SELECT p.cell_id, p.acc_cells, p.strahler, p.down_id, d.cell_id AS nxt FROM {mark}paths p LEFT JOIN {mark}kin k ON k.down_id=p.down_id AND k.strahler=p.strahler AND k.k=1
  LEFT JOIN {mark}paths d ON d.cell_id=k.down_id AND d.strahler=p.strahler)""",
        ),
        f"{mark}chain": ((f"{mark}merge",), f"{mark}chain AS (SELECT cell_id, cell_id AS last FROM {mark}mrg WHERE nxt IS NULL UNION ALL SELECT m.cell_id, c.last FROM {mark}chain c JOIN {mark}mrg m ON m.nxt=c.cell_id)"),
        f"{mark}reach": (
            (f"{mark}chain",),
            f"""{mark}reach AS (SELECT row_number() OVER (ORDER BY strahler, from_acc, start_cell) AS reach_id, * FROM (
  SELECT arg_min(h.cell_id, h.acc_cells) AS start_cell, c.last AS end_cell, count(*) AS cell_count, min(h.acc_cells) AS from_acc, max(h.acc_cells) AS to_acc, any_value(h.strahler) AS strahler, round(sum({length}),2) AS length_m
  FROM {mark}chain c JOIN {mark}mrg h USING (cell_id) GROUP BY c.last) q)""",
        ),
    }


def _open(name: str, m: int, inside: str) -> str:
    """Open cells and chosen outlets of the greedy cut of the relation ``inside`` (cell_id, down_id within it or -1)."""
    return f"""{name}_open(cell_id, cnt) USING KEY (cell_id) AS (
  SELECT cell_id, 1::BIGINT FROM {inside}
  UNION
  SELECT q.cell_id, q.n FROM (
    SELECT r.down_id AS cell_id, 1+sum(CASE WHEN t.cnt>={m} THEN 0 ELSE t.cnt END)::BIGINT AS n
    FROM recurring.{name}_open t JOIN {inside} r USING (cell_id) WHERE r.down_id>=0 GROUP BY 1) q
  JOIN recurring.{name}_open cur USING (cell_id) WHERE q.n<>cur.cnt),
{name} AS MATERIALIZED (SELECT cell_id, cnt AS open_cells FROM {name}_open JOIN {inside} USING (cell_id) WHERE cnt>={m} OR down_id<0)"""


PARTS |= {"ord": (("acc",), _orders("ord", "acc"))} | _reach_parts("", "shown") | _reach_parts("r", "kept")
PARTS |= {
    "kept": (("dasg", "shown"), "kept AS MATERIALIZED (SELECT * FROM shown WHERE cell_id IN (SELECT cell_id FROM dasg))"),
    "way": (
        ("dasg", "dgreedy"),
        """way AS (SELECT g.cell_id AS outlet_id, a.down_id AS cell_id, 1 AS n, sqrt(power(10.0*(a.down_id%125-a.cell_id%125),2)+power(10.0*(a.down_id//125-a.cell_id//125),2)) AS len FROM dgreedy g JOIN acc a USING (cell_id) WHERE a.down_id>=0
  UNION ALL SELECT w.outlet_id, a.down_id, w.n+1, w.len+sqrt(power(10.0*(a.down_id%125-a.cell_id%125),2)+power(10.0*(a.down_id//125-a.cell_id//125),2)) FROM way w JOIN dasg d ON d.cell_id=w.cell_id JOIN acc a ON a.cell_id=w.cell_id
  WHERE w.cell_id NOT IN (SELECT cell_id FROM dgreedy) AND a.down_id>=0)""",
    ),
    "greedy": (("acc",), _open("greedy", 100, "acc")),
    "asg": (("greedy",), "asg AS (SELECT cell_id, cell_id AS outlet_id FROM greedy UNION ALL SELECT r.cell_id, a.outlet_id FROM asg a JOIN rcv r ON r.down_id=a.cell_id WHERE r.cell_id NOT IN (SELECT cell_id FROM greedy))"),
    "inside": (("dom", "acc"), "inside AS MATERIALIZED (SELECT a.cell_id, CASE WHEN d2.cell_id IS NULL THEN -1 ELSE a.down_id END AS down_id, a.acc FROM acc a JOIN dom d USING (cell_id) LEFT JOIN dom d2 ON d2.cell_id=a.down_id)"),
    "dgreedy": (("inside",), _open("dgreedy", 100, "inside")),
    "dasg": (("dgreedy",), "dasg AS (SELECT cell_id, cell_id AS outlet_id FROM dgreedy UNION ALL SELECT r.cell_id, a.outlet_id FROM dasg a JOIN inside r ON r.down_id=a.cell_id WHERE r.cell_id NOT IN (SELECT cell_id FROM dgreedy))"),
    "subs": (
        ("dasg", "ord", "sord"),
        """subs AS MATERIALIZED (SELECT outlet_id, n AS cell_count, round(n*100.0,2) AS area_m2, round(round(n*100.0,2)/1e4,2) AS area_ha, coalesce(s.s, o.s)::INT AS strahler
  FROM (SELECT outlet_id, count(*) n FROM dasg GROUP BY 1) q LEFT JOIN ord o ON o.cell_id=q.outlet_id LEFT JOIN sord s ON s.cell_id=q.outlet_id)""",
    ),
    "down": (("dasg", "dgreedy"), "down AS MATERIALIZED (SELECT g.cell_id AS outlet_id, a.outlet_id AS ds_id FROM dgreedy g JOIN acc c USING (cell_id) LEFT JOIN dasg a ON a.cell_id=c.down_id)"),
    "depth": (("down",), "depth AS (SELECT outlet_id, 0::BIGINT AS depth FROM down WHERE ds_id IS NULL UNION ALL SELECT d.outlet_id, p.depth+1 FROM depth p JOIN down d ON d.ds_id=p.outlet_id)"),
}


def sql(select: str, *needed: str, grid: str = "branching") -> str:
    """WITH clauses of the needed parts, each after what it needs, then the select."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in PARTS[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in (grid, *needed):
        add(n)
    return "WITH RECURSIVE " + ",\n".join(PARTS[n][1] for n in order) + f"\n{select}"
