"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words build the automaton; every document's words then walk it, which tells
the longest match that ends at each word. Matches of ``window`` words or more, and whole
items that are shorter, are hits. Items go into blocks of a bounded number of words, each
with its own automaton, so that what is built and broadcast stays small however large the
test set. With several blocks, one scan of the documents asks a bit filter of the items' window
hashes; only documents that may hold a window are written, walk the automata block after
block, and are joined with their hits, which are put together before anything is counted or
cut. All other documents stay where they are.

Defined cases: null and empty texts have no words and are never hit; items without words
are ignored; items without an item_id hit and cut like others, but are not among the items reported; every text is
judged and cut by its own hits, whatever rows share its doc_id; an item_id on several rows
has all their windows; without items nothing is hit; an empty table gives no rows; other
columns are ignored by the report and pass through the cut, whatever their names; a very
long text is walked whole, and a task holds its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm._shared import BitFilter, cut, free_name
from talweg.llm._text import ALNUM, Chunk, chunks, longs, run_hashes

BLOCK_WORDS = 200_000
NO_ITEM = -(1 << 63)  # stands for items without an item_id


class Automaton:
    """Suffix automaton over the words of several items, with the items of each match.

    Windows are the items' runs of ``window`` words; an item of fewer words is one window.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.len)
        order = sorted(range(n), key=self.len.__getitem__)
        # the suffix of exactly ``window`` words of a match in state s ends in state deep[s]
        self.deep = [-1] * n
        for s in order:
            if self.len[s] >= window:
                up = self.link[s]
                self.deep[s] = s if self.len[up] < window else self.deep[up]
        self.items: dict[int, set[int]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        for item, words in items:
            s = 0
            for k, w in enumerate(words, 1):
                s = self.next[s][w]
                if k >= window:
                    self.items.setdefault(self.deep[s], set()).add(item)
            if 0 < len(words) < window:
                whole.setdefault(s, []).append((len(words), item))
        # short items that end wherever a match in state s ends: those of its suffixes too
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        for s in order[1:]:
            self.short[s] = (*whole.get(s, ()), *self.short[self.link[s]])
        self.any_short = bool(whole)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (first word, end; overlapping ones joined) and the items that hit."""
        nxt, link, length, deep, short, any_short, window = self.next, self.link, self.len, self.deep, self.short, self.any_short, self.window
        s = matched = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        root = nxt[0]
        for i, w in enumerate(words, 1):
            if not s:
                s = root.get(w, 0)
                if not s:
                    continue
                matched = 1
            else:
                t = nxt[s].get(w)
                while t is None and s:
                    s = link[s]
                    matched = length[s]
                    t = nxt[s].get(w)
                if t is None:
                    continue
                s = t
                matched += 1
            long = 0
            if matched >= window:
                long = window
                found |= self.items[deep[s]]
            if any_short:
                for n, item in short[s]:
                    if n <= matched:
                        found.add(item)
                        long = max(long, n)
            if long:
                a = i - long
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i))
        return spans, found


def _segments(items: DataFrame, window: int, id_col: str, text: str) -> DataFrame:
    """(item, words) with at most BLOCK_WORDS // 10 words a row; cuts overlap by window - 1 words, so no window is lost."""
    most = max(BLOCK_WORDS // 10, 2 * window)

    def split(batches):
        for c, rows in chunks(batches, ALNUM, lower=True):
            ids, out = rows.column(0).to_pylist(), []
            for d in range(c.n):
                words = c.words(d)
                for a in range(0, max(1, len(words) - window + 1), most):
                    if part := words[a : a + most + window - 1]:
                        out.append((ids[d], b" ".join(part), len(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["item", "words", "n"])

    return items.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ITEM)).alias("item"), F.col(text).cast("binary").alias("text")).mapInArrow(split, "item long, words binary, n long")


def _blocks(items: DataFrame, window: int, id_col: str = "item_id", text: str = "text", block_words: int | None = None) -> list[DataFrame]:
    """The items' segments in blocks of about block_words words at most, dealt by a hash."""
    block_words = block_words or BLOCK_WORDS
    segments = _segments(items, window, id_col, text).dropDuplicates(["item", "words"])
    total = segments.agg(F.sum("n")).first()[0] or 0
    if total <= block_words:
        return [segments]
    segments, n = cut(segments), -(-total * 2 // block_words)
    return [segments.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == b) for b in range(n)]


def _automaton(block: DataFrame, window: int) -> Automaton:
    return Automaton([(r.item, bytes(r.words).split(b" ")) for r in block.toLocalIterator()], window)


def _scan(c: Chunk, auto: Automaton):
    """(document, hit spans, items) of a chunk's documents that the automaton hits."""
    for d in range(c.n):
        spans, found = auto.hits(c.words(d))
        if found:
            yield d, spans, found


def _window_hashes(c: Chunk, window: int, sizes: list[int]):
    """(size, first words, hashes) of the chunk's runs of ``window`` words and of the other sizes."""
    for k in sorted({window, *sizes}):
        yield k, *c.windows(k)


def _maybe_hit(segments: DataFrame, window: int):
    """A test of chunks for documents that may hold a window of the segments: one bit filter of all windows' hashes, broadcast."""

    def hashes(batches):
        for c, _ in chunks(batches, ALNUM, text="words"):
            short = np.flatnonzero(c.n_words < window).tolist()
            whole = [run_hashes(c.word_hash[c.wptr[d] : c.wptr[d + 1]], int(c.n_words[d])) for d in short]
            h = np.concatenate([c.windows(window)[1], *whole]) if short else c.windows(window)[1]
            yield pa.RecordBatch.from_arrays([longs(h)], ["h"])

    found = cut(segments.select("words").mapInArrow(hashes, "h long").distinct())
    sizes = [r.n for r in segments.where(F.col("n") < window).select("n").distinct().collect()]
    sent = segments.sparkSession.sparkContext.broadcast((BitFilter.build(found, "h", found.count()), sizes))

    def test(c: Chunk) -> np.ndarray:
        known, sizes = sent.value
        out = np.zeros(c.n, bool)
        for _, at, h in _window_hashes(c, window, sizes):
            out[c.word_doc[at[known.might_contain(h)]]] = True
        return out

    return test


def _candidates(rows: DataFrame, text: str, maybe) -> tuple[DataFrame, DataFrame]:
    """rows that hold no window, and those that may."""

    at = rows.columns.index(text)

    def only(wanted: bool):
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                raw = b.set_column(at, pa.field(text, pa.binary()), b.column(at).cast(pa.binary()))
                keep = np.concatenate([maybe(c) for c, _ in chunks([raw], ALNUM, lower=True, text=text)])
                yield b.filter(pa.array(keep == wanted))

        return run

    return rows.mapInArrow(only(False), rows.schema), rows.mapInArrow(only(True), rows.schema)


def find_hits(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document row: its id, n_words, spans (flat first and end words of the hit spans) and items (sorted ids)."""
    schema = f"{id_col} long, n_words long, spans array<long>, items array<long>"
    names = [id_col, "n_words", "spans", "items"]
    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("binary").alias("text"))
    blocks = _blocks(items, window)
    only = docs.sparkSession.sparkContext.broadcast(_automaton(blocks[0], window)) if len(blocks) == 1 else None
    lists = pa.list_(pa.int64())

    def scan(batches):
        for c, rows in chunks(batches, ALNUM, lower=True):
            if only is None:
                spans, found = (rows.column(k) if rows.num_columns > 2 else pa.nulls(c.n, lists) for k in (2, 3))
            else:
                spans, found = [None] * c.n, [None] * c.n
                for d, s, f in _scan(c, only.value):
                    spans[d], found[d] = [x for pair in s for x in pair], sorted(f - {NO_ITEM})
                spans, found = (pa.array(x, lists) for x in (spans, found))
            yield pa.RecordBatch.from_arrays([rows.column(0), longs(c.n_words), spans, found], names)

    if only is not None:
        return source.mapInArrow(scan, schema)
    clean, some = _candidates(source, "text", _maybe_hit(_all(blocks), window))
    some = cut(some.withColumn("_key", F.sha2("text", 256)))
    hits = _hits_by_text(some.select("_key", "text"), blocks, window)
    some = some.join(hits, "_key", "left").select(id_col, "text", "_spans", "_items")
    return clean.mapInArrow(scan, schema).unionByName(some.mapInArrow(scan, schema))


def _all(blocks: list[DataFrame]) -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def _hits_by_text(texts: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """(_key, _spans, _items): the hit spans, flat, and the items of all blocks in each text that any of them hits; rows of one key have one text.

    One block after the other is built, sent, walked by all texts and given up again, so that
    neither driver nor executors hold more than one automaton; its hits are written.
    """
    sc, parts = texts.sparkSession.sparkContext, []
    for k, block in enumerate(blocks):
        sent = sc.broadcast(_automaton(block, window))

        def scan(batches, sent=sent):
            for c, rows in chunks(batches, ALNUM, lower=True):
                hit = [(d, [x for pair in spans for x in pair], sorted(items - {NO_ITEM})) for d, spans, items in _scan(c, sent.value)]
                types = (pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array([x[0] for x in hit], pa.int64())), *(pa.array([x[j] for x in hit], t) for j, t in enumerate(types, 1))], ["_key", "_spans", "_items"])

        found = texts.mapInArrow(scan, "_key string, _spans array<long>, _items array<long>")
        parts.append(cut(found.withColumn("block", F.lit(k))))
        sent.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # equal texts have equal hits in a block: one of each is enough
    each = found.groupBy("_key", "block").agg(F.first("_spans").alias("_spans"), F.first("_items").alias("_items"))
    return each.groupBy("_key").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))


def _joined(flat: list[int] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])) if flat else ():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The digest of each document's hits: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def digest(batches):
        for b in batches:
            ids, n, spans, found = (b.column(k).to_pylist() for k in range(4))
            hit = [sum(e - a for a, e in _joined(s)) for s in spans]
            sha = [hashlib.sha256(",".join(sorted(map(str, f or ()))).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(f or ()) for f in found], pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit])],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return find_hits(docs, items, window).mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the benchmark: hit spans of words are cut out of the texts, and documents of which they cover more than ``max_coverage`` of the words are dropped.

    The spans of all blocks are found on the uncut text and joined before a document is
    judged and cut, so the number of blocks makes no difference.
    Clean rows stay as they are, in all columns; n_chars, where there is one, follows the text.
    """
    at = docs.columns.index(text)
    fix = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    blocks = _blocks(items, window)
    only = docs.sparkSession.sparkContext.broadcast(_automaton(blocks[0], window)) if len(blocks) == 1 else None
    source, schema, names = docs, docs.schema, docs.columns
    if only is None:
        by, spans = free_name("_key", names), free_name("_spans", names)
        untouched, some = _candidates(docs, text, _maybe_hit(_all(blocks), window))
        some = cut(some.withColumn(by, F.sha2(F.col(text).cast("binary"), 256)))
        hits = _hits_by_text(some.select(F.col(by).alias("_key"), F.col(text).cast("binary").alias("text")), blocks, window)
        source = some.join(hits.select(F.col("_key").alias(by), F.col("_spans").alias(spans)), by, "left").select(*names, spans)

    def clean(batches):
        for b in batches:
            table = b.set_column(at, pa.field(text, pa.binary()), b.column(at).cast(pa.binary())) if b.num_rows else b
            for c, rows in chunks([table], ALNUM, lower=True, text=text):
                new, keep, changed = rows.column(at).to_pylist(), np.ones(c.n, bool), False
                if only is None:
                    hit = [(d, _joined(flat)) for d, flat in enumerate(rows.column(rows.num_columns - 1).to_pylist()) if flat]
                    rows = rows.select(names)
                else:
                    hit = [(d, spans) for d, spans, _ in _scan(c, only.value)]
                for d, spans in hit:
                    changed = True
                    keep[d] = sum(e - a for a, e in spans) <= max_coverage * (c.wptr[d + 1] - c.wptr[d])
                    new[d] = cut_spans(new[d], [(int(c.ws[c.wptr[d] + a] - c.off[d]), int(c.we[c.wptr[d] + e - 1] - c.off[d])) for a, e in spans])
                if changed:
                    texts = pa.array([None if t is None else t.decode() for t in new], pa.string())
                    rows = rows.set_column(at, pa.field(text, pa.string()), texts)
                    if fix is not None:
                        sizes = [x if same else None if t is None else len(t) for x, t, same in zip(rows.column(fix).to_pylist(), texts.to_pylist(), _unchanged(c, new))]
                        rows = rows.set_column(fix, rows.schema.field(fix), pa.array(sizes, rows.schema.field(fix).type))
                    rows = rows.filter(pa.array(keep))
                else:
                    rows = rows.set_column(at, pa.field(text, pa.string()), rows.column(at).cast(pa.string()))
                yield rows

    cleaned = source.mapInArrow(clean, schema)
    return cleaned if only is not None else untouched.unionByName(cleaned)


def _unchanged(c: Chunk, new: list) -> list[bool]:
    return [t is None or len(t) == c.off[d + 1] - c.off[d] for d, t in enumerate(new)]


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """raw without its byte spans; one space stands where text remains on both sides."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b" ".join(p for p in (x.strip() if 0 < k < len(parts) - 1 else x.rstrip() if k == 0 else x.lstrip() for k, x in enumerate(parts)) if p)
