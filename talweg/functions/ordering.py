"""Numbering rows in an order, without one task for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.lineage import cut


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """rows with ``name``: 1, 2, ... in a total order.

    Rows are dealt to partitions by ranges of the order; a partition numbers its own rows,
    after those of the partitions before it. The driver sees one count for each partition.
    """
    if not hasattr(rows, "_talweg_path"):
        rows = cut(rows)  # ranges are found by reading the rows once before
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts, before, total = {r._part: r.n for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}, [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    first = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(first), "_part").withColumn(name, (F.col("_before") + within).cast("long")).drop("_part", "_before")
