"""Merkle manifest of a dataset, with a proof and a tamper check for each row.

H is the lowercase hex SHA-256 of its inputs, end to end; digests go in as hex text. A row's
leaf is H of its fields. The leaves of a language form a tree of fan 8, by doc_id; the roots
of the languages form one more, in the order of their UTF-8 bytes, null first.

Spark makes the leaves (texts are read once, in the JVM), numbers them by ranges and deals
them, without any text, to aligned buckets of 8**4 = 4096 leaves. A task reads whole buckets as
Arrow tables, and DuckDB runs the levels on them: an ordered string_agg of each 8 digests,
then sha256. That gives a root for each bucket; these roots are leaves of a tree of their own,
so the same step climbs it, and the tree of languages after it. On the way back each bucket
gets its outer proof (the runs of digests above it) as one row beside its leaves, and DuckDB
makes each leaf's proof and folds the checked leaf up to the root.

Neither leaves nor bucket roots pass the driver or one task: each climb divides the nodes by
4096, and a language of any size is many buckets.

Defined cases: null fields count as ``-``; rows without doc_id come first in their language,
rows of equal doc_id by their leaf; equal rows are leaves of their own; a row without doc_id
is not tampered with; a lone leaf is its language's root, and a lone language's root is the
root; the proof of a row without siblings is H of nothing; texts are hashed whole, however
long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.lineage import cut
from talweg.functions.ordering import numbered

FAN, LEVELS = 8, 4
SPAN = FAN**LEVELS  # leaves of a bucket
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUNS = "array<struct<s:string,o:int>>"  # runs of digests above a node, and its place in each


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """H of a row's fields, with this text."""
    return F.sha2(F.concat(*(_field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def tampered(doc_id: Column) -> Column:
    """Whether the check tampers with the row."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _tree(lang: Column) -> Column:
    """A language as a string of the right order: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, pos, n, id, h, folded): each row's place among the n of its language, its leaf, and the leaf to check."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    plain = leaf(F.col("text"))
    checked = F.when(tampered(F.col("doc_id")) & (F.col("text") != lower), leaf(lower)).otherwise(F.lit(None))
    made = cut(docs.select(_tree(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("id"), F.unhex(plain).alias("h"), F.unhex(checked).alias("folded")))
    rows = numbered(made, "number", "tree", F.col("id").asc_nulls_first(), "h")
    rows = cut(rows)
    trees = rows.groupBy("tree").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("n"))
    return rows.join(trees, "tree").select("tree", (F.col("number") - F.col("start")).alias("pos"), "n", "id", F.lower(F.hex("h")).alias("h"), F.lower(F.hex(F.coalesce("folded", "h"))).alias("folded"))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n."""
    return F.size(F.filter(F.array(*(F.lit(FAN**k).cast("long") for k in range(21))), lambda p: p < n))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.expr(f"pos div {SPAN}")).repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "pos")


def _whole_buckets(batches) -> Iterator[pa.Table]:
    """Tables of whole buckets; their rows come sorted, tree and bucket in the first two columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = lambda k, b=b: (b.column(0)[k].as_py(), b.column(1)[k].as_py())
        last, at = key(b.num_rows - 1), b.num_rows - 1
        low, high = 0, at  # first row of the last bucket
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if key(mid) == last else (mid + 1, high)
        if held and (low or (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != last):
            yield pa.Table.from_batches([*held, b.slice(0, low)])
            held = []
        elif low:
            yield pa.Table.from_batches([b.slice(0, low)])
        held.append(b.slice(low))
    if held:
        yield pa.Table.from_batches(held)


def _engine():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    return con


def _arrow(con, sql: str) -> list[pa.RecordBatch]:
    return con.sql(sql).to_arrow_table().to_batches()


def _levels(con, table: pa.Table) -> None:
    """Temporary tables of a table (tree, bucket, pos, levels, h): node0 .. node4, and run0 .. run3, the runs of 8 that each level's nodes form."""
    con.register("rows_in", table)
    con.execute(f"CREATE OR REPLACE TEMP TABLE node0 AS SELECT tree, bucket, pos % {SPAN} AS p, levels, h FROM rows_in WHERE h IS NOT NULL")
    con.unregister("rows_in")
    for k in range(LEVELS):
        con.execute(f"CREATE OR REPLACE TEMP TABLE run{k} AS SELECT tree, bucket, p // {FAN} AS p, min(levels) AS levels, string_agg(h, '' ORDER BY p) AS s FROM node{k} WHERE levels > {k} GROUP BY tree, bucket, p // {FAN}")
        con.execute(f"CREATE OR REPLACE TEMP TABLE node{k + 1} AS SELECT tree, bucket, p, levels, sha256(s) AS h FROM run{k} UNION ALL SELECT * FROM node{k} WHERE levels <= {k}")


def _bucket_roots(batches):
    con = _engine()
    for t in _whole_buckets(batches):
        _levels(con, t)
        yield from _arrow(con, f"SELECT tree, bucket, h FROM node{LEVELS}")


def _runs_sql(select: str, extra: str = "") -> str:
    """Rows of node0 beside the runs above them inside their bucket."""
    joins = " ".join(f"LEFT JOIN run{k} ON run{k}.tree = a.tree AND run{k}.bucket = a.bucket AND run{k}.p = a.p // {FAN ** (k + 1)}" for k in range(LEVELS))
    return f"SELECT {select} FROM node0 a {joins} {extra}"


def _place(k: int) -> str:
    return f"(a.p // {FAN**k}) % {FAN}"


def _paths(batches):
    """(tree, pos, path): each node's runs inside its bucket, then those above the bucket."""
    con = _engine()
    own = ", ".join(f"CASE WHEN run{k}.s IS NOT NULL THEN {{'s': run{k}.s, 'o': ({_place(k)})::INT}} END" for k in range(LEVELS))
    for t in _whole_buckets(batches):
        _levels(con, t)
        _outer(con, t)
        sql = _runs_sql(f"a.tree, a.bucket * {SPAN} + a.p AS pos, list_filter([{own}], lambda x: x IS NOT NULL) || o.path AS path", "JOIN outer_runs o ON o.tree = a.tree AND o.bucket = a.bucket")
        yield from _arrow(con, sql)


def _outer(con, t: pa.Table) -> int:
    """The outer proofs that came with the buckets, as a temporary table; the length of the longest."""
    con.register("rows_in", t)
    con.execute("CREATE OR REPLACE TEMP TABLE outer_runs AS SELECT tree, bucket, path FROM rows_in WHERE h IS NULL")
    con.unregister("rows_in")
    return con.execute("SELECT coalesce(max(len(path)), 0) FROM outer_runs").fetchall()[0][0]


def _without(s: str, o: str) -> str:
    return f"left({s}, 64 * ({o})) || substr({s}, 64 * ({o}) + 65)"


def _with(s: str, o: str, h: str) -> str:
    return f"sha256(left({s}, 64 * ({o})) || {h} || substr({s}, 64 * ({o}) + 65))"


def _proofs(batches):
    """(id, leaf, subroot_runs, proof, folded): each leaf with H of its siblings, and the checked leaf folded with them."""
    con = _engine()
    for t in _whole_buckets(batches):
        _levels(con, t)
        longest = _outer(con, t)
        con.register("rows_in", t)
        con.execute(f"CREATE OR REPLACE TEMP TABLE given AS SELECT tree, bucket, pos % {SPAN} AS p, id, folded FROM rows_in WHERE h IS NOT NULL")
        con.unregister("rows_in")
        siblings = " || ".join(f"coalesce({_without(f'run{k}.s', _place(k))}, '')" for k in range(LEVELS))
        runs = ", ".join(f"run{k}.s AS s{k}, {_place(k)} AS o{k}" for k in range(LEVELS))
        sql = _runs_sql(f"a.tree, a.bucket, a.p, a.h AS leaf, g.id, g.folded AS f, o.path AS path, {siblings} AS siblings, {runs}", "JOIN given g ON g.tree = a.tree AND g.bucket = a.bucket AND g.p = a.p JOIN outer_runs o ON o.tree = a.tree AND o.bucket = a.bucket")
        for k in range(LEVELS):
            sql = f"SELECT * REPLACE (CASE WHEN s{k} IS NULL THEN f ELSE {_with(f's{k}', f'o{k}', 'f')} END AS f) FROM ({sql})"
        sql = f"SELECT id, leaf, tree, f, siblings, path FROM ({sql})"
        for k in range(1, longest + 1):
            s, o = f"path[{k}].s", f"path[{k}].o"
            sql = f"SELECT * REPLACE (CASE WHEN len(path) < {k} THEN f ELSE {_with(s, o, 'f')} END AS f, siblings || CASE WHEN len(path) < {k} THEN '' ELSE {_without(s, o)} END AS siblings) FROM ({sql})"
        sql = f"SELECT id, leaf, tree, sha256(siblings) AS proof_sha256, f AS folded_root FROM ({sql})"
        yield from _arrow(con, sql)


def _bucket_level(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dealt nodes (tree, pos, n, h, ...): the trees' roots (tree, root), each bucket's outer runs (tree, bucket, path), and the rows to hand to a task."""
    rows = nodes.withColumn("levels", F.least(_height(F.col("n")), F.lit(LEVELS)))
    dealt = _dealt(rows).select("tree", "bucket", "pos", "levels", "h")
    made = cut(dealt.mapInArrow(_bucket_roots, "tree string, bucket long, h string").join(rows.groupBy("tree").agg(F.first("n").alias("n")), "tree"))
    none = F.array().cast(RUNS)
    if most <= SPAN:
        return made.select("tree", F.col("h").alias("root")), made.select("tree", "bucket", none.alias("path")), rows
    above = made.select("tree", F.col("bucket").alias("pos"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), "h")
    roots, paths = climb(above, -(-most // SPAN))
    return roots, paths.select("tree", F.col("pos").alias("bucket"), "path"), rows


def _with_outer(rows: DataFrame, outer: DataFrame) -> DataFrame:
    """The nodes dealt to buckets, each bucket's outer runs as one more row before them, without a join."""
    marks = outer.select("tree", (F.col("bucket") * SPAN).alias("pos"), "bucket", "path", F.lit(0).alias("after"))
    both = rows.withColumn("bucket", F.expr(f"pos div {SPAN}")).withColumn("after", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    return both.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "after", "pos")


def climb(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Roots (tree, root) and the runs above each node (tree, pos, path) of trees of at most ``most`` nodes (tree, pos, n, h)."""
    roots, outer, rows = _bucket_level(nodes, most)
    paths = _with_outer(rows, outer).select("tree", "bucket", "pos", "levels", "h", "path").mapInArrow(_paths, f"tree string, pos long, path {RUNS}")
    return roots, cut(paths)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    nodes = cut(leaves(docs))
    most = nodes.agg(F.max("n")).first()[0]
    if most is None:
        return nodes.selectExpr("id doc_id", "h leaf", "h subroot", "h root", "h proof_sha256", "h folded_root", "true verified")
    roots, outer, rows = _bucket_level(nodes, most)
    roots = cut(roots)
    langs = numbered(roots, "number", "tree").select("tree", (F.col("number") - 1).alias("place"), "root")
    n_langs = roots.count()
    tops, above = climb(langs.select(F.lit("").alias("tree"), F.col("place").alias("pos"), F.lit(n_langs).cast("long").alias("n"), F.col("root").alias("h")), n_langs)
    root = tops.first().root
    of_lang = cut(langs.join(above.select(F.col("pos").alias("place"), F.col("path").alias("top")), "place").select("tree", F.col("root").alias("subroot"), "top"))
    outer = outer.join(of_lang, "tree").select("tree", "bucket", F.concat("path", "top").alias("path"))
    schema = "id long, leaf string, tree string, proof_sha256 string, folded_root string"
    made = _with_outer(rows, outer).select("tree", "bucket", "pos", "levels", "h", "path", "id", "folded").mapInArrow(_proofs, schema)
    return made.join(of_lang.select("tree", "subroot"), "tree").select(
        F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


#: The registered query in SQL: CRC by bits, levels and folds by recursion.
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 0 AS step, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, step + 1, xor(x >> 1, 3988292384 * (x & 1))
  FROM (SELECT doc_id, s, step, CASE WHEN step % 8 = 0 THEN xor(c, ascii(substr(s, step // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc WHERE step < 8 * length(s))
), touched AS (
  SELECT doc_id FROM crc WHERE step = 8 * length(s) AND xor(c, 4294967295) % 3 = 0
), texts AS (
  SELECT d.doc_id, d.lang, coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(d.source) || ':' || d.source, '-') || coalesce(strlen(d.lang) || ':' || d.lang, '-') || coalesce(strlen(d.n_chars::VARCHAR) || ':' || d.n_chars, '-') AS head,
    d.text, CASE WHEN t.doc_id IS NULL THEN d.text ELSE translate(d.text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') END AS lower
  FROM documents d LEFT JOIN touched t ON d.doc_id = t.doc_id
), hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(lower) || ':' || lower, '-')) AS checked FROM texts
), leaves AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM hashed
), nodes AS (
  SELECT tree, 0 AS l, p, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, l + 1, p // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY p)) FROM nodes WHERE n > 1 GROUP BY tree, l, p // 8, n
), subroots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS langs FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS l, place AS p, langs AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT l + 1, p // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY p)) FROM tops WHERE n > 1 GROUP BY l, p // 8, n
), siblings AS (
  SELECT a.id, b.l, string_agg(b.h, '' ORDER BY b.p) AS s FROM leaves a JOIN nodes b ON b.tree = a.tree AND b.p // 8 = a.p // (8 ** (b.l + 1))::BIGINT AND b.p <> a.p // (8 ** b.l)::BIGINT AND b.n > 1 GROUP BY a.id, b.l
  UNION ALL
  SELECT a.id, 100 + b.l, string_agg(b.h, '' ORDER BY b.p) FROM leaves a JOIN subroots r ON r.tree = a.tree JOIN tops b ON b.p // 8 = r.place // (8 ** (b.l + 1))::BIGINT AND b.p <> r.place // (8 ** b.l)::BIGINT AND b.n > 1 GROUP BY a.id, b.l
), proofs AS (
  SELECT a.id, sha256(coalesce(string_agg(s.s, '' ORDER BY s.l), '')) AS proof_sha256 FROM leaves a LEFT JOIN siblings s ON s.id = a.id GROUP BY a.id
), folds AS (
  SELECT id, tree, 0 AS l, p, checked AS h, n FROM leaves
  UNION ALL
  SELECT f.id, f.tree, f.l + 1, f.p // 8, sha256(string_agg(CASE WHEN b.p = f.p THEN f.h ELSE b.h END, '' ORDER BY b.p)), (f.n + 7) // 8
  FROM folds f JOIN nodes b ON b.tree = f.tree AND b.l = f.l AND b.p // 8 = f.p // 8 WHERE f.n > 1 GROUP BY f.id, f.tree, f.l, f.p, f.n
), folded AS (
  SELECT f.id, 0 AS l, r.place AS p, f.h, r.langs AS n FROM folds f JOIN subroots r ON r.tree = f.tree WHERE f.n = 1
  UNION ALL
  SELECT f.id, f.l + 1, f.p // 8, sha256(string_agg(CASE WHEN b.p = f.p THEN f.h ELSE b.h END, '' ORDER BY b.p)), (f.n + 7) // 8
  FROM folded f JOIN tops b ON b.l = f.l AND b.p // 8 = f.p // 8 WHERE f.n > 1 GROUP BY f.id, f.l, f.p, f.n
)
SELECT a.doc_id, a.leaf, r.subroot, t.h AS root, p.proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaves a JOIN subroots r ON r.tree = a.tree JOIN proofs p ON p.id = a.id JOIN folded f ON f.id = a.id AND f.n = 1 CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
"""
