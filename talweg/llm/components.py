"""Connected components of links, by union-find and alternating star rounds on DataFrames.

Each task first joins its own links by union-find, which leaves one link for each node
of a local tree. Then large-star and small-star rounds follow until nothing changes; each
works on sums by node that Spark combines before it shuffles, so a node with very many
links is no bottleneck. Between rounds the links are written to the shared folder. Once no
more than ``SMALL`` links are left, one task joins them by union-find, which is as much as
any task takes at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm._shared import cut, drop_cut
from talweg.llm._text import longs


SMALL = 500_000  # links that one task joins


def union_find(a: list[int], b: list[int]) -> dict[int, int]:
    """Each node's least reachable one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while (p := parent.setdefault(r, r)) != r:
            r = p
        while parent[x] != r:
            parent[x], x = r, parent[x]
        return r

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def _local(batches):
    """Links of one task, replaced by (node, least node of its local tree); SMALL of them or so at a time."""
    held, n = [], 0

    def joined():
        t = pa.Table.from_batches(held)
        tree = union_find(t.column(0).to_pylist(), t.column(1).to_pylist())
        pairs = [(u, v) for u, v in tree.items() if u != v]
        return pa.RecordBatch.from_arrays([longs(np.array([p[k] for p in pairs], np.int64)) for k in range(2)], ["u", "v"])

    for b in batches:
        for at in range(0, b.num_rows, SMALL):
            held.append(b.slice(at, SMALL))
            n += held[-1].num_rows
            if n > SMALL:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links lead to, for every node of links (u, v)."""
    edges = cut(links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").mapInArrow(_local, "u long, v long").distinct())
    before, left = None, edges.count()
    if left <= SMALL:
        edges = cut(edges.coalesce(1).mapInArrow(_local, "u long, v long"))
    while left > SMALL:
        # large star: every larger neighbour of u hangs on u's least neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours hang on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = cut(small)
        drop_cut(edges)
        edges = after
        # the same links as before: every node hangs on its least one
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, left = state, state[0]
        if left <= SMALL:
            edges = cut(edges.coalesce(1).mapInArrow(_local, "u long, v long"))
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
