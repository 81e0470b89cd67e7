"""Lines that stand in many documents, by a range-partitioned stream of their hashes.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least
``LEAST_LENGTH`` characters in at least ``LEAST_DOCS`` documents lose all their lines except
in the last document (the largest doc_id) that holds them.

Spark splits and hashes the lines (16 bytes of a SHA-256) and deals the hashes, without any
text, to ranges of (hash, document from the last on, row, line), sorted in this order. A task
streams its range: a key's first document is the one that keeps its lines, and from the fifth
document on the lines of all others go at once, so at most four documents of a key are held.
A key in very many documents spans ranges. Such a key is the first or last of a range, and a
range tells two rows about its ends: how many documents of the key it saw, the first, and the
last. The rows of undecided keys wait for the sum of these, which is at most two rows a task.

The result is a bitmap for each row that loses lines, one bit a line, compressed; texts are
not shuffled for it. To cut lines, only the rows that lose some are joined with the bitmaps.

Defined cases: null and empty texts are one empty line; rows that share a doc_id are one
document, and if it is the last one, all its rows keep the line; rows without doc_id come
before all ids, each a document of its own unless they have the same text; lines are read
whole, however long; a row all of whose lines go keeps an empty text; an empty table gives no
rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.llm._shared import cut, free_name, picker

LEAST_LENGTH, LEAST_DOCS = 40, 5
SPACES = " \t\n\x0b\x0c\r"
NO_ID = 1 << 62  # rows without an id are numbered down from -NO_ID - 1
MARKS = "h binary, doc long, row long, pos int, part int, n long, last long"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def _keys(docs: DataFrame) -> list[Column]:
    """doc: what a row's document goes by; row: tells rows of one document apart by their text."""
    row = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-NO_ID - 1) - F.pmod(row, F.lit(NO_ID))).alias("doc"), row.alias("row")]


def line_hashes(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(h, doc, row, pos) of the lines whose key is long enough."""
    lines = docs.where("text is not null").select(*_keys(docs), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_length)
    return keyed.select(F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("h"), "doc", "row", "pos")


class _Stream:
    """The sorted rows of one range: what is decided here, and what is known of the keys at its ends."""

    def __init__(self, least: int):
        self.least, self.part = least, TaskContext.get().partitionId()
        self.first_key = self.key = None  # of the range; of the rows seen last
        self.held: list[pa.Table] = []  # rows of self.key while it has too few documents
        self.n = 0
        self.top = self.last = None  # documents of self.key: how many, the first, the last seen

    def out(self, t: pa.Table, rows: np.ndarray, undecided: bool = False) -> pa.RecordBatch:
        m = len(rows)
        columns = [t.column(k).combine_chunks().take(pa.array(rows)) for k in range(4)]
        if not undecided:
            columns[0] = pa.nulls(m, pa.binary())
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(m, self.part), pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], [x.split()[0] for x in MARKS.split(", ")])

    def summary(self) -> pa.RecordBatch:
        values = [[self.key], [self.top], [None], [None], [self.part], [self.n], [self.last]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], [x.split()[0] for x in MARKS.split(", ")])

    def end_key(self, at_end: bool = False):
        """The key of the rows seen last is over, in this range."""
        if self.key is not None and (at_end or self.key == self.first_key):
            for t in self.held:
                yield self.out(t, np.flatnonzero(t.column(1).to_numpy() != self.top) if self.key != self.first_key else np.arange(t.num_rows), True)
            yield self.summary()
        self.held, self.n, self.top, self.last = [], 0, None, None

    def run(self, t: pa.Table, key: bytes):
        """Further rows of one key that may go on."""
        if key != self.key:
            yield from self.end_key()
            self.key = key
            if self.first_key is None:
                self.first_key = key
        doc = t.column(1).to_numpy()
        if self.top is None:
            self.top = int(doc[0])
        before = self.n
        self.n += int((doc[1:] != doc[:-1]).sum()) + (self.last is None or int(doc[0]) != self.last)
        self.last = int(doc[-1])
        if key == self.first_key:
            yield self.out(t, np.arange(t.num_rows), True)
        elif self.n >= self.least:
            for x in ([] if before >= self.least else self.held) + [t]:
                yield self.out(x, np.flatnonzero(x.column(1).to_numpy() != self.top))
            self.held = []
        else:
            self.held.append(t)

    def __call__(self, batches):
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            h = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(-1, 2)
            doc, row, pos = (b.column(k).to_numpy() for k in (1, 2, 3))
            fresh = np.ones(len(h), bool)  # rows that are repeated whole count once
            new_key = (h[1:] != h[:-1]).any(axis=1)
            fresh[1:] = new_key | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1])
            at = np.flatnonzero(fresh)
            t, h, doc = t.take(pa.array(at)), h[at], doc[at]
            begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]).any(axis=1)))
            key = lambda k: h[begin[k]].tobytes()
            yield from self.run(t.slice(0, int(begin[1]) if len(begin) > 1 else t.num_rows), key(0))
            if len(begin) > 2:  # keys that begin and end in this batch, all at once
                a, z = int(begin[1]), int(begin[-1])
                length = np.diff(begin[1:])
                of = np.repeat(np.arange(len(length)), length)
                d = doc[a:z]
                step = np.append(True, d[1:] != d[:-1])
                step[begin[1:-1] - a] = True
                docs_of = np.add.reduceat(step.astype(np.int64), begin[1:-1] - a)
                top = d[begin[1:-1] - a]
                yield from self.end_key()
                yield self.out(t, a + np.flatnonzero((docs_of[of] >= self.least) & (d != top[of])))
                self.key = None
            if len(begin) > 1:
                yield from self.run(t.slice(int(begin[-1])), key(-1))
        yield from self.end_key(at_end=True)


def dropped_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, row, pos) of the lines that go; may repeat rows."""
    hashes = cut(line_hashes(docs, least_length))  # written before it is dealt, as ranges are found by reading it
    order = ("h", F.col("doc").desc(), "row", "pos")
    marks = cut(hashes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _Stream(least_docs)(it), MARKS))
    by_range = Window.partitionBy("h").orderBy("part")
    again = F.when(F.lag("last").over(by_range) == F.col("doc"), 1).otherwise(0)  # a document that two ranges saw
    ends = marks.where("n is not null").select("h", "doc", (F.col("n") - again).alias("n"))
    known = ends.groupBy("h").agg(F.sum("n").alias("docs"), F.max("doc").alias("top")).where(F.col("docs") >= least_docs).select("h", "top")
    waiting = marks.where("h is not null and n is null").select("h", "doc", "row", "pos").join(F.broadcast(known), "h").where(F.col("doc") != F.col("top"))
    return marks.where("h is null").select("doc", "row", "pos").unionByName(waiting.select("doc", "row", "pos"))


def keep_bitmaps(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, row, keep): of each row that loses lines, zlib of a bit for each line up to the last that goes; 1 stays."""

    def pack(batches):
        for b in batches:
            bits = []
            for gone in b.column(2):
                at = np.array(gone.as_py())
                keep = np.ones((int(at.max()) // 8 + 1) * 8, bool)
                keep[at] = False
                bits.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["doc", "row", "keep"])

    gone = dropped_lines(docs, least_length, least_docs).groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))
    return gone.mapInArrow(pack, "doc long, row long, keep binary")


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """Text without the lines that the bitmap drops, lines before, lines dropped."""
    lines = text.split(b"\n")
    if bitmap is None:
        return text, len(lines), 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)[: len(lines)]
    keep = np.append(keep, np.ones(len(lines) - len(keep), bool))
    return b"\n".join([x for x, k in zip(lines, keep.tolist()) if k]), len(lines), int((~keep).sum())


def report(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bitmaps = cut(keep_bitmaps(rows, least_length, least_docs))
    keyed = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_keys(rows)).withColumn("key", F.xxhash64("doc", "row"))
    pick = picker(bitmaps.select(F.xxhash64("doc", "row").alias("key")), "key")

    def digest(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                made = [kept_lines(t.as_py(), k.as_py()) for t, k in zip(part.column(1), part.column(2))]
                columns = [pa.array([m[k] for m in made], pa.int64()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array([hashlib.sha256(m[0]).hexdigest() for m in made], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    whole = keyed.mapInArrow(pick(False), keyed.schema)
    n_lines = F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1
    same = whole.select("doc_id", n_lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
    hit = keyed.mapInArrow(pick(True), keyed.schema).join(bitmaps, ["doc", "row"], "left")
    return same.unionByName(hit.select("doc_id", F.col("text").cast("binary").alias("text"), "keep").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"))


def drop_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs without the lines that go; n_chars, where there is one, follows the text."""
    doc, row, key, keep = (free_name(x, docs.columns) for x in ("_doc", "_row", "_key", "_keep"))
    bitmaps = cut(keep_bitmaps(docs, least_length, least_docs).toDF(doc, row, keep))
    at = docs.columns.index("text")
    fix = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    keyed = docs.select("*", *(c.alias(x) for c, x in zip(_keys(docs), (doc, row)))).withColumn(key, F.xxhash64(doc, row))
    pick = picker(bitmaps.select(F.xxhash64(doc, row).alias(key)), key)
    schema = docs.schema

    def clean(batches):
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                columns = [part.column(k) for k in range(len(schema))]
                texts = columns[at].to_pylist()
                sizes = columns[fix].to_pylist() if fix is not None else []
                for i, bits in enumerate(part.column(len(schema))):
                    if bits.is_valid:
                        texts[i] = kept_lines(texts[i].encode(), bits.as_py())[0].decode()
                        if fix is not None:
                            sizes[i] = len(texts[i])
                columns[at] = pa.array(texts, pa.string())
                if fix is not None:
                    columns[fix] = pa.array(sizes, part.schema.field(fix).type)
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    whole = keyed.mapInArrow(pick(False), keyed.schema).select(*docs.columns)
    hit = keyed.mapInArrow(pick(True), keyed.schema).join(bitmaps, [doc, row], "left")
    return whole.unionByName(hit.select(*docs.columns, keep).mapInArrow(clean, schema))


#: The registered query in SQL.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), often AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= {LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id <> o.top, false) AS gone FROM lines l LEFT JOIN often o ON l.key = o.key)
GROUP BY doc_id
"""
