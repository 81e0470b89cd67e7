"""Mixing sources to target weights.

Sizes are summed by source, targets follow from the weights, and a document of a source
with rate r = target / size is emitted floor(r) times, plus once more if a seeded hash of
its id falls below the fraction of r. Everything runs on DataFrame functions.

Defined cases: a null text has size 0; null is a source of its own, after all others;
rows that share a doc_id fare alike; documents of size 0 follow their source's rate, and a
source without words has target 0 and rate 0; an empty table gives no rows; a doc_id of
null is hashed as an empty string; very long texts are counted in the JVM like others;
all columns of the table stay, and a name that it has already is not used again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.llm._shared import cut, free_name

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
BROADCAST_SOURCES = 100_000  # rows of a plan that is broadcast, some 50 bytes each
SALT = 64  # partitions of one source's rows beyond that


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with weight, target and rate.

    target = least of most * source_size and level * weight, where level shares out all
    sizes: with sources in order of most * size / weight, the sources that stop at their
    limit are a prefix, and the level follows from two running sums. One row for each
    source goes through the ordered windows, not one for each document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("weight", cycle).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    up = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("place", F.row_number().over(order)).withColumn("held", F.coalesce(F.sum("limit").over(up), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0)))
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.col("held")) / F.col("open"))
    # the first source whose limit is not reached fixes the level; equal limits are told apart by the order of the sources
    s = s.withColumn("level", F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct("place", "level"))).over(every)["level"])
    target = F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def drawn_by(doc_id: Column, text: Column) -> Column:
    """What a row's draw is made from: its id, or its text where it has none, so that rows without ids do not share one draw."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary"))), F.lit(""))


def copies(rate: Column, drawn: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more with probability of the fraction, decided by ``drawn``."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), drawn)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def _with_rates(rows: DataFrame, plan: DataFrame, spread: list[Column], names: dict[str, str]) -> DataFrame:
    """rows with their source's size, target and rate; rows are not shuffled while the plan can be broadcast.

    Beyond ``BROADCAST_SOURCES`` sources both sides are shuffled, and a source's rows are
    dealt over ``SALT`` partitions by a hash of ``spread``, each of which gets the plan's row.
    """
    key, salt, part = (free_name(x, rows.columns) for x in ("_mix_source", "_mix_salt", "_mix_part"))
    plan = plan.select(F.col("source").alias(key), *(F.col(k).alias(v) for k, v in names.items()))
    same = F.col("source").eqNullSafe(F.col(key))
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), same).drop(key)
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(SALT)))
    every = plan.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.join(every.hint("merge"), same & (F.col(salt) == F.col(part))).drop(key, salt, part)


def _plan(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """targets() of rows (source, size), written once: a row for each source."""
    return cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixture: each row of docs as often as it is to be read, with ``copy`` counting from 1 (``copy_`` where docs have a column copy)."""
    plan = _plan(docs.select("source", word_count(F.col("text")).alias("size")), weights, most)
    rate, times, copy = (free_name(x, docs.columns) for x in ("_mix_rate", "_mix_copies", "copy"))
    out = _with_rates(docs, plan, [F.col("doc_id"), F.length("text")], {"rate": rate})
    out = out.withColumn(times, copies(F.col(rate), drawn_by(F.col("doc_id"), F.col("text")), seed)).where(F.col(times) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns, copy)


def report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target (of the source), taken (words that the mixture reads); texts are counted once."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), drawn_by(F.col("doc_id"), F.col("text")).alias("drawn")))
    m = _with_rates(sized, _plan(sized, weights, most), [F.col("doc_id"), F.col("size")], {k: k for k in ("source_size", "target", "rate")})
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("drawn"), seed)).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(doc_id::VARCHAR, 'text:' || md5(text), '') AS drawn FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1)::INT]::BIGINT AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, source_size * {MOST} AS lim, row_number() OVER (ORDER BY source_size * {MOST} / weight, source IS NULL, source) AS place,
         coalesce(sum(source_size * {MOST}) OVER up, 0)::BIGINT AS held,
         (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0))::BIGINT AS open,
         (sum(source_size) OVER ())::BIGINT AS total
  FROM s WINDOW up AS (ORDER BY source_size * {MOST} / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min((total - held) / open, place) AS level FROM c WHERE lim >= (total - held) / open * weight
), t AS (
  SELECT source, source_size, least(lim::DOUBLE, level * weight) AS target FROM c, l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('{SEED}:' || d.drawn), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)!r}::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
