"""Substring dedup on a log-structured fingerprint index.

The index holds the windows of all documents that were added to it, in sorted immutable
runs, one for each batch. A window of ``window`` words has an anchor, the least hash of its
short word runs: equal windows have equal anchors, and about six neighbouring windows share
one, so a run has a row for each stretch of such windows: its anchor, its first place
(doc, start), and 48 bits of each window's hash. Anchors and those bits come from two
independent hash families. A second sorted table of the run counts its anchors.

A batch is tokenised once, into its run. Its counts are merge-joined with those of earlier
runs, which tells the anchors that stand in more than one place by now. Only stretches
under these, of the batch and of history, go on; they meet under their anchors, where
window by window is verified, and every window of the batch but the first of its kind is a
duplicate. Documents of earlier batches are never read again. ``FAN_IN`` runs of one level
are compacted into one of the next, of fewer and longer sorted files.

Two windows count as equal if their anchors (64 bits) and their own 48 bits agree. Windows
that differ but share an anchor share ten words, so the 48 bits tell them apart: among m
different windows about one anchor the chance of any error is m * m / 2**49, for a million
0.002. Windows that share no words must agree in all 112 bits.

An index with a path outlives its session: a manifest beside the runs names them, and is
swapped by one rename after each batch, so a batch is in the index whole or not at all.

Few repeated anchors reach the tasks as a bit filter, whose false positives only cost
comparisons; more than it has room for are joined. Each piece of a task drops its own
later occurrences first, so a passage in very many documents gives a row for each piece,
not for each document; stretches under very frequent anchors are dealt window by window,
where the rows of a window come sorted and only its first is held.

Order: batches in the order in which they are added, then doc_id, then start. A single call
cuts its documents into batches by doc_id, so there the order is that of the ids.

Defined cases: null and empty texts have no words and lose nothing; rows that share a
doc_id are one document, and the same start in them is one occurrence, also when it is
added again; rows without doc_id come after all others, each a document of its own unless
they have the same text; texts above ``LONG`` bytes are read in parts that overlap, with
the same result; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm._shared import MOST_FILTERED, BitFilter, cut, drop_cut, free_name, picker
from talweg.llm._text import U, Chunk, chunks, longs, mix, run_hashes, trim

WINDOW, RUN = 20, 10  # words of a window, and of the word runs that anchors are chosen from
BATCHES = 3  # of a single call
FAN_IN = 2
HOT = 256  # stretches from which an anchor's windows are dealt one by one
NO_ID = 1 << 62  # documents without an id are numbered from here
PIECE = 200_000  # windows verified at a time
MANIFEST = "manifest.json"
LONG = 8 << 20  # bytes of a text from which it is cut
TEXT = 1 << 19  # bytes of text whose windows are found at once
BYTES = 6  # of a window's hash in a run
RUN_SCHEMA = "h long, doc long, start long, n long, hashes binary"


def document_key(doc_id: Column, text: Column) -> Column:
    """The number that a row's document goes by."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text).bitwiseAND(NO_ID - 1) + F.lit(NO_ID))


def _anchors(c: Chunk, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the chunk's windows and their anchors."""
    run = min(run, window)
    at = c.window_starts(window)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    low, have, want = run_hashes(c.word_hash, run), 1, window - run + 1
    while have < want:  # least of ``have`` neighbours, doubled
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return at, low[at]


def _stretches(at: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where windows ``at`` start anew: after a gap, or where one of ``same`` changes."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _lengths(first: np.ndarray, end: int) -> np.ndarray:
    return np.diff(np.append(first, end))


def _blobs(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """BYTES bytes of each stretch's window hashes as bytes."""
    off = pa.py_buffer((np.append(first, len(h)) * BYTES).astype(np.int32))
    low = np.ascontiguousarray(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :BYTES])
    return pa.Array.from_buffers(pa.binary(), len(first), [None, off, pa.py_buffer(low)])


_SPACE, _WORDS = re.compile(rb"[ \t-\r]"), {}


def text_parts(raw: bytes, overlap: int):
    """(number of the first word, bytes) of a text in parts of about LONG bytes, each with the next ``overlap`` words too."""
    more = _WORDS.setdefault(overlap, re.compile(rb"(?:[ \t-\r]+[^ \t-\r]+){0,%d}" % overlap))
    at = first = 0
    while at + LONG < len(raw) and (border := _SPACE.search(raw, at + LONG)):
        yield first, raw[at : more.match(raw, border.start()).end()]
        first += len(raw[at : border.start()].split())
        at = border.start()
    yield first, raw[at:]


def _bounded_rows(batches, overlap: int):
    """Rows (doc, text) as (doc, text, number of the text's first word), long texts in parts."""
    for b in batches:
        size = pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        a = 0
        for k in [*np.flatnonzero(size > LONG).tolist(), b.num_rows]:
            if k > a:
                yield pa.RecordBatch.from_arrays([*b.slice(a, k - a).columns, pa.array(np.zeros(k - a, np.int64))], ["doc", "text", "first"])
            if k < b.num_rows:
                for first, part in text_parts(b.column(1)[k].as_py(), overlap):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([part], pa.binary()), pa.array([first])], ["doc", "text", "first"])
            a = k + 1


def _run_rows(c: Chunk, keys: np.ndarray, first_word: np.ndarray, window: int, run: int):
    """The piece's stretches, and those of windows that it holds earlier (without anchor and hashes)."""
    at, a = _anchors(c, window, run)
    if not len(at):
        return
    h, doc = c.windows(window, 1)[1], c.word_doc[at]
    start = at - c.wptr[doc] + first_word[doc]
    # windows in the order of (document, start); the first of each kind in the piece stays open
    rank = np.empty(c.n, np.int64)
    rank[np.argsort(keys, kind="stable")] = np.arange(c.n)
    turn = np.argsort(rank[doc], kind="stable") if np.any(np.diff(keys) < 0) else np.arange(len(at))
    order = turn[np.argsort(h[turn], kind="stable")]
    hs, anchor, where, place = h[order], a[order], keys[doc[order]], start[order]
    first = np.ones(len(h), bool)
    first[1:] = (hs[1:] != hs[:-1]) | (anchor[1:] != anchor[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    later = np.zeros(len(h), bool)
    later[order[(where != where[head]) | (place != place[head])]] = True
    names = ["h", "doc", "start", "n", "hashes"]
    i = np.flatnonzero(later)
    if len(i):
        b = _stretches(at[i], doc[i])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()), longs(keys[doc[i[b]]]), longs(start[i[b]]), longs(_lengths(b, len(i))), pa.nulls(len(b), pa.binary())], names)
    i = np.flatnonzero(~later)
    if len(i):
        b = _stretches(at[i], doc[i], a[i])
        yield pa.RecordBatch.from_arrays([longs(a[i[b]]), longs(keys[doc[i[b]]]), longs(start[i[b]]), longs(_lengths(b, len(i))), _blobs(h[i], b)], names)


def stretches(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """Rows of RUN_SCHEMA of docs (doc, text): sorted within each partition, those of windows that a piece repeats first, with a null anchor."""

    def make(batches):
        for c, rows in chunks(_bounded_rows(batches, window - 1), size=TEXT):
            yield from _run_rows(c, *(rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 2)), window, run)

    return docs.select("doc", "text").mapInArrow(make, RUN_SCHEMA).sortWithinPartitions("h")


@dataclass(eq=False)
class Run:
    """Immutable sorted tables of one batch or of several: stretches (RUN_SCHEMA), and anchors with the number of stretches (h, n)."""

    rows: DataFrame
    counts: DataFrame
    level: int = 0

    def drop(self) -> None:
        drop_cut(self.rows)
        drop_cut(self.counts)


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


COUNT_SCHEMA = "h long, n long"


class FingerprintIndex:
    """Runs, oldest first. add() gives what a batch repeats, of itself or of all that came before.

    With a path (a folder that all executors share) the index stays there, and open() finds
    it again in another session; one writer at a time. Without, it ends with the session.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, run: int = RUN, fan_in: int | None = None, path: str | None = None):
        self.spark, self.window, self.run, self.fan_in = spark, window, run, fan_in or FAN_IN
        self.path = path.rstrip("/") if path else None
        self.runs: list[Run] = []
        self.compactions = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "FingerprintIndex":
        """The index that an earlier session left at the path."""
        told = json.loads(spark.read.text(f"{path.rstrip('/')}/{MANIFEST}", wholetext=True).first()[0])
        out = cls(spark, told["window"], told["run"], told["fan_in"], path)
        out.runs = [Run(out._read(r["rows"], RUN_SCHEMA), out._read(r["counts"], COUNT_SCHEMA), r["level"]) for r in told["runs"]]
        return out

    def _read(self, name: str, schema: str) -> DataFrame:
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        df._talweg_path = f"{self.path}/{name}"
        return df

    def _keep(self, df: DataFrame, schema: str) -> DataFrame:
        """df as a table of the index."""
        if not self.path:
            return cut(df)
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}")
        return self._read(name, schema)

    def _tell(self) -> None:
        """Swaps the manifest for one that names the present runs."""
        if not self.path:
            return
        name = lambda df: df._talweg_path.rpartition("/")[2]
        told = {"window": self.window, "run": self.run, "fan_in": self.fan_in, "runs": [{"rows": name(r.rows), "counts": name(r.counts), "level": r.level} for r in self.runs]}
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        new, old = (hadoop.Path(f"{self.path}/{x}") for x in (f"{MANIFEST}-{uuid.uuid4().hex}", MANIFEST))
        out = new.getFileSystem(conf).create(new)
        out.write(json.dumps(told).encode())
        out.close()
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(old.toUri(), conf).rename(new, old, how)

    def add(self, docs: DataFrame) -> DataFrame:
        """(doc, a, b): word spans of docs (doc, text binary) that repeated windows cover, perhaps overlapping. The batch is in the index then."""
        self._compact()
        rows = self._keep(stretches(docs, self.window, self.run), RUN_SCHEMA)
        counts = self._keep(rows.where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("h"), COUNT_SCHEMA)
        if self.runs:
            before = _together([r.counts for r in self.runs]).groupBy("h").agg(F.sum("n").alias("before"))
            # the outer side is the batch: history is only looked up
            counted = counts.join(before.hint("merge"), "h", "left").select("h", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"))
        else:
            counted = counts
        repeated = cut(counted.where("n > 1"))
        spans = cut(self._spans(rows, repeated))
        drop_cut(repeated)
        self.runs.append(Run(rows, counts))
        self._tell()
        return spans

    def _spans(self, rows: DataFrame, repeated: DataFrame) -> DataFrame:
        window = self.window
        every = rows.where("h is not null").withColumn("age", F.lit(1).cast("long"))
        if self.runs:
            every = every.unionByName(_together([r.rows for r in self.runs]).where("h is not null").withColumn("age", F.lit(0).cast("long")))
        crowded = repeated.where(F.col("n") >= HOT)
        n_repeated, n_crowded = repeated.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") >= HOT, 1))).first()
        if n_repeated > MOST_FILTERED:
            every = every.join(repeated.select("h").hint("merge"), "h", "left_semi")
            many = None
        else:
            many = BitFilter.build(repeated, "h", n_repeated)
        # frequent anchors beyond the filter's size only make more stretches go window by window
        hot = BitFilter.build(crowded, "h", n_crowded, max_bytes=4 << 20)
        sent = self.spark.sparkContext.broadcast((many, hot))
        keyed = every.select("h", "age", "doc", "start", "n", "hashes").mapInArrow(lambda it: _keyed(it, *sent.value), "key long, age long, doc long, start long, n long, hashes binary")
        found = keyed.repartition("key").sortWithinPartitions("key", "age", "doc", "start").mapInArrow(lambda it: _verified(it, window), "doc long, a long, b long")
        own = rows.where("h is null").select("doc", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + window).alias("b"))
        return found.unionByName(own)

    def _compact(self) -> None:
        """Runs of one level, once there are ``fan_in`` of them, become one of the next: fewer and longer sorted files, and one count for each anchor."""
        while len(last := [r for r in self.runs if r.level == self.runs[-1].level]) >= self.fan_in:
            # one scan of all their files, which Spark deals to tasks by size: nothing is shuffled
            rows = self.spark.read.schema(RUN_SCHEMA).parquet(*(r.rows._talweg_path for r in last))
            rows = self._keep(rows.where("h is not null").sortWithinPartitions("h"), RUN_SCHEMA)
            counts = self._keep(_together([r.counts for r in last]).groupBy("h").agg(F.sum("n").alias("n")).sortWithinPartitions("h"), COUNT_SCHEMA)
            self.runs = [r for r in self.runs if r not in last] + [Run(rows, counts, last[0].level + 1)]
            self._tell()
            for r in last:
                r.drop()
            self.compactions += 1

    def clear(self) -> None:
        for r in self.runs:
            r.drop()
        self.runs = []
        self._tell()


def _flat(column: pa.Array) -> np.ndarray:
    """The window hashes of a column of blobs, end to end."""
    out = []
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        off = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
        raw = np.zeros(((off[-1] - off[0]) // BYTES, 8), np.uint8)
        if len(raw):
            raw[:, :BYTES] = np.frombuffer(part.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(-1, BYTES)
        out.append(raw.view(np.uint64).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _keyed(batches, many: BitFilter | None, hot: BitFilter):
    """Stretches under repeated anchors, by anchor; those under frequent ones window by window, by anchor and window."""
    names = ["key", "age", "doc", "start", "n", "hashes"]
    for b in batches:
        a = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        if many is not None:
            keep = many.might_contain(a)
            b, a = b.filter(pa.array(keep)), a[keep]
        if not len(a):
            continue
        crowd = hot.might_contain(a)
        if not crowd.all():
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(~crowd)).columns, names)  # fields like those below
        if crowd.any():
            b, a = b.filter(pa.array(crowd)), a[crowd]
            n, h = b.column(4).to_numpy(), _flat(b.column(5))
            row = np.repeat(np.arange(len(n)), n)
            place = b.column(3).to_numpy()[row] + np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            key = mix(a[row] ^ mix(h))
            yield pa.RecordBatch.from_arrays([longs(key), b.column(1).take(pa.array(row)), longs(b.column(2).to_numpy()[row]), longs(place), longs(np.ones(len(h), np.int64)), _blobs(h, np.arange(len(h)))], names)


def _verify(rows: list[pa.RecordBatch], window: int) -> pa.RecordBatch:
    """(doc, a, b) of the batch's windows (age 1) that stand earlier elsewhere; rows of a key must be together."""
    t = pa.Table.from_batches(rows)
    key, age, doc, start, n = (t.column(k).to_numpy() for k in range(5))
    h = _flat(t.column(5))
    row = np.repeat(np.arange(len(n)), n)
    place = start[row] + np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((place, doc[row], age[row], key[row], h))
    hs, ks, ds, ps = h[order], key[row][order], doc[row][order], place[order]
    first = np.ones(len(h), bool)
    first[1:] = (hs[1:] != hs[:-1]) | (ks[1:] != ks[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    later = np.zeros(len(h), bool)
    later[order] = ((ds != ds[head]) | (ps != ps[head])) & (age[row][order] == 1)
    i = np.flatnonzero(later)
    b = _stretches(i, row[i])
    s = place[i[b]]
    return pa.RecordBatch.from_arrays([longs(doc[row[i[b]]]), longs(s), longs(s + _lengths(b, len(i)) - 1 + window)], ["doc", "a", "b"])


def _verified(batches, window: int):
    """Rows come sorted by key, age, doc and start. A key of more windows than PIECE is one window's, so its first row stands for those seen."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += int(b.column(4).to_numpy(zero_copy_only=False).sum())
        if size >= PIECE:
            t = pa.Table.from_batches(held)
            key = t.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1]))  # the last key may go on
            yield _verify((t.slice(0, end) if end else t).to_batches(), window)
            rest = t.slice(end) if end else t.slice(0, 1)
            held, size = rest.to_batches(), int(rest.column(4).to_numpy().sum())
            del t, key
            trim()
    if held:
        yield _verify(held, window)


def _keyed_texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select(document_key(F.col("doc_id"), text).alias("doc"), text.alias("text"))


def duplicate_spans(docs: DataFrame, window: int = WINDOW, run: int = RUN, batches: int | None = None, index: FingerprintIndex | None = None) -> DataFrame:
    """(doc, spans): for each document that repeats earlier windows, the word spans (a, b) that these cover, in any order, perhaps overlapping.

    Without an index, the documents go into one of their own in ``batches`` batches by
    their ids. With one, they are its next batch, after all that it holds.
    """
    source = _keyed_texts(docs)
    if index is not None:
        found = index.add(source)
    else:
        index, batches = FingerprintIndex(docs.sparkSession, window, run), batches or BATCHES
        borders = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)], 10_000).alias("b")).first()[0] if batches > 1 else None
        edges = [None, *(sorted(set(borders)) if borders else []), None]
        parts = []
        for low, high in zip(edges[:-1], edges[1:]):
            part = source if low is None else source.where(F.col("doc") > low)
            parts.append(index.add(part if high is None else part.where(F.col("doc") <= high)))
        found = _together(parts)
        index.clear()
    return found.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(flat: list[int] | None) -> list[tuple[int, int]]:
    """Disjoint sorted spans."""
    out: list[list[int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])) if flat else ():
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _flat_spans(docs: DataFrame, window: int, run: int, index: FingerprintIndex | None, key: str, spans: str) -> DataFrame:
    """(key, spans): the documents that lose words, with their flat spans; written, as it is read twice."""
    got = duplicate_spans(docs, window, run, index=index)
    return cut(got.select(F.col("doc").alias(key), F.flatten(F.transform("spans", lambda s: F.array(s["a"], s["b"]))).alias(spans)))


def _digest(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Words, words in the disjoint sorted spans, and the digest of the others."""
    n = kept = 0
    sha = hashlib.sha256()
    for first, part in text_parts(raw, 0):
        words = part.split()
        n = first + len(words)
        for a, b in reversed(spans):
            del words[max(0, a - first) : max(0, b - first)]
        if words:
            sha.update((b" " if kept else b"") + b" ".join(words))
            kept += len(words)
    return n, n - kept, sha.hexdigest()


def report(docs: DataFrame, window: int = WINDOW, run: int = RUN, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def digest(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                spans = part.column(3).to_pylist() if part.num_columns > 3 else [None] * part.num_rows
                n, gone, sha = [], [], []
                for text, flat in zip(part.column(1), spans):
                    for x, value in zip((n, gone, sha), _digest(text.as_py() or b"", merged(flat))):
                        x.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    text = F.col("text").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), document_key(F.col("doc_id"), text).alias("doc"))
    found = _flat_spans(docs, window, run, index, "doc", "spans")
    # rows that lose nothing are digested where they are read: only the others are shuffled
    pick = picker(found, "doc")
    whole, hit = pick(False), rows.mapInArrow(pick(True), rows.schema)
    cut_rows = hit.join(found, "doc", "left").select("doc_id", "text", "doc", "spans")
    return rows.mapInArrow(lambda it: digest(whole(it)), schema).unionByName(cut_rows.mapInArrow(digest, schema))


def remove_duplicates(docs: DataFrame, window: int = WINDOW, run: int = RUN, index: FingerprintIndex | None = None) -> DataFrame:
    """docs without the words that repeated windows cover.

    Texts without such words stay as they are; a document of which no word is left goes;
    n_chars, where there is one, follows the text.
    """
    from talweg.llm.decontamination import cut_spans

    at = docs.columns.index("text")
    fix = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema = docs.schema
    key, name = free_name("_doc_key", docs.columns), free_name("_spans", docs.columns)

    def clean(batches):
        for batch in batches:
            table = batch.set_column(at, pa.field("text", pa.binary()), batch.column(at).cast(pa.binary()))
            for c, rows in chunks([table]):
                texts, flats = rows.column(at).to_pylist(), rows.column(len(schema)).to_pylist()
                keep = np.ones(c.n, bool)
                sizes = rows.column(fix).to_pylist() if fix is not None else []
                for d, flat in enumerate(flats):
                    if not flat:
                        continue
                    spans, base = merged(flat), c.wptr[d]
                    keep[d] = sum(b - a for a, b in spans) < c.wptr[d + 1] - base
                    texts[d] = cut_spans(texts[d], [(int(c.ws[base + a] - c.off[d]), int(c.we[base + b - 1] - c.off[d])) for a, b in spans])
                    if fix is not None:
                        sizes[d] = len(texts[d].decode())
                columns = [rows.column(k) for k in range(len(schema))]
                columns[at] = pa.array([None if t is None else t.decode() for t in texts], pa.string())
                if fix is not None:
                    columns[fix] = pa.array(sizes, rows.schema.field(fix).type)
                yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(keep))

    found = _flat_spans(docs, window, run, index, key, name)
    rows, pick = docs.withColumn(key, document_key(F.col("doc_id"), F.col("text").cast("binary"))), picker(found, key)
    untouched, hit = (rows.mapInArrow(pick(x), rows.schema) for x in (False, True))
    # written, so that no task holds the Python workers of both steps: an executor would keep twice as many
    cleaned = cut(hit.join(found, key, "left").select(*docs.columns, name)).mapInArrow(clean, schema)
    return untouched.select(*docs.columns).unionByName(cleaned)
