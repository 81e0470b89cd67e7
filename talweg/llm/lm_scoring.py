"""Language-model scores from a log-frequency Bloom filter.

Counts of single words and of word pairs in the training documents are quantised on a
logarithmic scale: a count of level q enters the filter q times, once with each number up
to q. Scoring asks for level 1, 2, ... until an answer is no; the level reached stands for
the count. Pair and word estimates are interpolated:

    P(w | v) = PAIR * count(v w) / count(v) + (1 - PAIR) * (count(w) + 1) / (N + V + 1)

A document is read as end, words, end. The filter grows with the number of distinct
n-grams, ``BITS`` bits for each level of each, at any size. It is broadcast up to
``max_bytes``. A larger one of pairs stays a table of pieces, and the documents' distinct
pairs are shuffled to the pieces: the score is a sum in which each
pair has its own term. Pairs that make up more than one in ``most_frequent`` of all tokens
are known everywhere, so that none of the rest is asked for by very many documents. Either
way the documents are read as often, whatever their number. Exact word counts, for the base score, are broadcast while there
are at most ``max_words`` of them; beyond, those of frequent words are, and a row gets its other words' counts by a shuffle.
Where a filter of words would pass ``max_bytes``, there is none, and the exact counts give the words' levels.

Defined cases: a null text is empty and has one token, its end; a null doc_id belongs to
the training documents; rows that share a doc_id are scored row by row; an empty table
gives no rows; without training documents every count is zero; other columns are ignored;
a very long text is one piece of its task, some 60 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm._shared import cut, drop_cut
from talweg.llm._text import SPACE, U, Chunk, chunks, longs, mix

FOLDS, HELD_OUT = 7, 2
BASE = 1.5  # of the logarithmic scale
PAIR = 0.4  # weight of the pair estimate
MAX_BYTES = 128 << 20  # of a broadcast filter
MOST_FREQUENT = 1 << 20  # pairs with a larger share of all tokens than one in so many are broadcast; there are no more of them than that
SAMPLE = 64  # one pair of so many tells how many there are
MAX_WORDS = 8_000_000  # of a broadcast table of word counts, 16 bytes each
PROBES, BITS = 4, 12  # bits for each distinct n-gram level
PIECE_ENTRIES = 600_000  # of one piece of the filter, about: what a task sorts at once
SCORED = 1 << 19  # bytes of text scored at once
COUNTED = 1 << 20  # bytes of text whose pairs are counted at once
END = U(0x1D8E4E27C47D124F)  # hash of the end of a document
_GOLD, _WORD, _PAIR = 0x9E3779B97F4A7C15, U(0x2545F4914F6CDD1D), U(0x5851F42D4C957F2D)
_LEVELS = 96
_EDGES = BASE ** np.arange(1, _LEVELS)  # counts below _EDGES[q - 1] have level q at most


def level(count: np.ndarray) -> np.ndarray:
    """1 + floor(log of count), 0 for 0."""
    return np.where(count > 0, 1 + np.searchsorted(_EDGES, count, "right"), 0)


def _level_counts() -> np.ndarray:
    """Mean count of each level."""
    out = [0.0]
    for q in range(1, _LEVELS):
        low, high = int(np.ceil(BASE ** (q - 1) - 1e-9)), int(np.ceil(BASE**q - 1e-9)) - 1
        out.append((low + high) / 2)
    return np.array(out)


LEVEL_COUNT = _level_counts()


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the chunk's tokens (each document's words, then its end), of those before them, and each document's first token."""
    start = c.wptr[:-1] + np.arange(c.n)
    token = np.full(len(c.ws) + c.n, END, np.uint64)
    token[np.arange(len(c.ws)) + c.word_doc] = c.word_hash
    before = np.empty_like(token)
    before[:1], before[1:] = END, token[:-1]
    return token, before, start


def word_key(token: np.ndarray) -> np.ndarray:
    return mix(token ^ _WORD)


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + token)


def _tally(docs: DataFrame) -> DataFrame:
    """(pair, h, n): counts of all tokens, and of the pairs whose hash is a multiple of SAMPLE, from which the number of all pairs is told."""

    def count(batches):
        for c, _ in chunks(batches, SPACE, lower=True, size=COUNTED):
            token, before, _ = _tokens(c)
            pairs = pair_key(before, token)
            for pair, h in ((False, token), (True, pairs[pairs % U(SAMPLE) == 0])):
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), pair)), longs(h), longs(n)], ["pair", "h", "n"])

    got = docs.select("doc_id", "text").mapInArrow(count, "pair boolean, h long, n long")
    return got.groupBy("pair", "h").agg(F.sum("n").alias("n"))


def _packed(h: np.ndarray, n: np.ndarray, pieces: int, **more: np.ndarray) -> pa.RecordBatch:
    """Counts (h, n), and what else belongs to them, as one row for each piece of the filter: its hashes and counts as bytes. A few bytes a pair cross the shuffle, not a row."""
    piece = (h % U(pieces)).astype(np.int64)
    order = np.argsort(piece, kind="stable")
    piece = piece[order]
    start = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(piece) else np.zeros(0, np.int64)
    columns = {"h": h, "n": n.astype(np.int64)} | more
    blobs = []
    for x in columns.values():
        off = pa.py_buffer((np.append(start, len(piece)) * x.itemsize).astype(np.int32))
        blobs.append(pa.Array.from_buffers(pa.binary(), len(start), [None, off, pa.py_buffer(np.ascontiguousarray(x[order]))]))
    return pa.RecordBatch.from_arrays([pa.array(piece[start].astype(np.int32)), *blobs], ["piece", *columns])


def _pair_counts(docs: DataFrame, pieces: int) -> DataFrame:
    """(piece, h, n): packed counts of the pairs; a task's pieces of text count apart."""

    def count(batches):
        for c, _ in chunks(batches, SPACE, lower=True, size=COUNTED):
            token, before, _ = _tokens(c)
            yield _packed(*np.unique(pair_key(before, token), return_counts=True), pieces)

    return docs.select("doc_id", "text").mapInArrow(count, "piece int, h binary, n binary")


class LogFrequencyFilter:
    """Quantised counts by membership, in pieces that are each built by one task."""

    def __init__(self, bits: np.ndarray, pieces: int):
        self.bits, self.pieces = bits, pieces
        self.piece_bits = len(bits) * 8 // pieces

    @staticmethod
    def _places(h: np.ndarray, number: np.ndarray | int, piece_bits: int):
        with np.errstate(over="ignore"):
            item = mix(h + np.uint64(number) * U(_GOLD))
        # double hashing: the item's own halves give all its places
        a, b = item >> U(32), (item & U(0xFFFFFFFF)) | U(1)
        for i in range(PROBES):
            yield ((a + U(i) * b) % U(piece_bits)).astype(np.int64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram: the numbers are asked for in turn until one is missing."""
        out = np.zeros(len(h), np.int64)
        if not len(self.bits):
            return out
        live = np.arange(len(h))
        base = (h % U(self.pieces)).astype(np.int64) * self.piece_bits
        for number in range(1, _LEVELS):
            yes = np.ones(len(live), bool)
            for place in self._places(h[live], number, self.piece_bits):
                at = base[live] + place
                yes &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live = live[yes]
            out[live] = number
            if not len(live):
                break
        return out

    @staticmethod
    def table(packed: DataFrame, pieces: int, piece_bytes: int, frequent: int = 0) -> DataFrame:
        """(piece, bits, h, n): the pieces of the filter of packed counts, in which an n-gram may stand several times, and as bytes the n-grams counted ``frequent`` times or more.

        A task holds the counts of one piece. Pieces grow in number with the n-grams, so a
        task's share stays the same.
        """
        piece_bits = piece_bytes * 8

        def fill(batches):
            held: dict[int, list] = {}
            for b in batches:
                for p, h, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    held.setdefault(p, []).append((np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)))
            for p in list(held):
                h, n = (np.concatenate(x) for x in zip(*held.pop(p)))
                order = np.argsort(h, kind="stable")
                h, n = h[order], n[order]
                start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                h, n = h[start], np.add.reduceat(n, start)
                deep = level(n)
                bits = np.zeros(piece_bits, bool)
                for number in range(1, int(deep.max()) + 1):
                    for place in LogFrequencyFilter._places(h[deep >= number], number, piece_bits):
                        bits[place] = True
                often = n >= frequent if frequent else np.zeros(len(n), bool)
                blobs = [x.tobytes() for x in (np.packbits(bits, bitorder="little"), h[often], n[often])]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], ["piece", "bits", "h", "n"])

        return packed.repartitionById(pieces, F.col("piece")).mapInArrow(fill, "piece int, bits binary, h binary, n binary")

    @classmethod
    def build(cls, packed: DataFrame, pieces: int, piece_bytes: int) -> "LogFrequencyFilter":
        """The whole filter; the driver gets pieces * piece_bytes, which are written before it reads them."""
        made = cut(cls.table(packed, pieces, piece_bytes).select("piece", "bits"))
        bits = np.zeros(pieces * piece_bytes, np.uint8)
        for row in made.toLocalIterator():
            bits[row.piece * piece_bytes : (row.piece + 1) * piece_bytes] = np.frombuffer(row.bits, np.uint8)
        drop_cut(made)
        return cls(bits, pieces)


def _pieces(entries: int) -> int:
    return max(16, -(-entries // PIECE_ENTRIES))


def _piece_bytes(entries: int, pieces: int) -> int:
    return max(64, entries * BITS // 8 // pieces + 1)


def _word_table(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts; for a checked number of words."""

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(k).to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for k in range(2)], ["h", "n"])

    return _sorted_table(counts.select("h", "n").mapInArrow(pack, "h binary, n binary"))


def _sorted_table(blobs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and their counts, from rows of bytes."""
    rows = list(blobs.toLocalIterator())
    h = np.frombuffer(b"".join(r.h for r in rows), np.uint64)
    n = np.frombuffer(b"".join(r.n for r in rows), np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _look_up(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    keys, n = table
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, n[at], 0)


def _with_counts(numbered: DataFrame, counts: DataFrame, frequent) -> DataFrame:
    """numbered with the counts (h, n) of each row's tokens that are not frequent: the distinct ones meet their counts in a shuffle, and go back to their row."""

    def ask(batches):
        for c, rows in chunks(batches, SPACE, lower=True):
            token, _, start = _tokens(c)
            row = np.repeat(rows.column(2).to_numpy(), np.diff(np.append(start, len(token))))
            rare = np.flatnonzero(_look_up(frequent.value, token) == 0)
            order = rare[np.lexsort((token[rare], row[rare]))]
            t, r = token[order], row[order]
            at = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (r[1:] != r[:-1]))) if len(t) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([longs(r[at]), longs(t[at])], ["row", "h"])

    met = numbered.mapInArrow(ask, "row long, h long").join(counts, "h").groupBy("row").agg(F.collect_list(F.struct("h", "n")).alias("known"))
    return numbered.join(met, "row", "left").select(*numbered.columns, F.col("known.h").alias("h"), F.col("known.n").alias("n"))


def _row_counts(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The table of the counts that _with_counts() gave to the rows."""
    h, n = (rows.column(rows.schema.get_field_index(x)).flatten().to_numpy(zero_copy_only=False) for x in ("h", "n"))
    h, at = np.unique(h.view(np.uint64), return_index=True)
    return h, n[at]


def score(docs: DataFrame, held_out: Column | None = None, max_bytes: int = MAX_BYTES, max_words: int = MAX_WORDS, pair_weight: float = PAIR, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    out_of = is_held_out(F.col("doc_id")) if held_out is None else held_out
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), out_of.alias("held_out"))
    training = source.where(~F.col("held_out"))
    tally = cut(_tally(training))
    counts = tally.where("not pair").select("h", "n")
    levels = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BASE)) + 1e-9) + 1
    got = {r.pair: r for r in tally.groupBy("pair").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(levels).alias("levels")).collect()}
    distinct, total, word_levels = (int(getattr(got[False], x)) if False in got else 0 for x in ("k", "n", "levels"))
    # every pair has the same chance to be in the sample; a tenth more covers its spread
    pair_levels = int(got[True].levels * SAMPLE * 1.1) + 1000 if True in got else 1000

    pieces = _pieces(word_levels)
    words = LogFrequencyFilter.build(_keyed(counts, pieces), pieces, _piece_bytes(word_levels, pieces)) if word_levels * BITS // 8 <= max_bytes else None
    broadcast_pairs = pair_levels * BITS // 8 <= max_bytes
    uniform = float(total + distinct + 1)
    broadcast_words = distinct <= max_words
    # beyond max_words the frequent words alone are sent: the rest meet their rows in a shuffle, in which no word has very many
    table = spark.sparkContext.broadcast(_word_table(counts if broadcast_words else counts.where(F.col("n") > total // most_frequent)))
    word_filter = spark.sparkContext.broadcast(words)
    numbered = source if broadcast_words and broadcast_pairs else source.withColumn("row", F.monotonically_increasing_id())
    if "row" in numbered.columns:
        numbered = cut(numbered.select("doc_id", "text", "row", "held_out"))  # the numbers must stay the same in every scan
    else:
        numbered = numbered.select("doc_id", "text", F.lit(0).cast("long").alias("row"), "held_out")
    if not broadcast_words:
        numbered = cut(_with_counts(numbered, counts, table))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    pieces = _pieces(pair_levels)
    packed = _pair_counts(training, pieces)
    if broadcast_pairs:
        bits = None
        pairs = spark.sparkContext.broadcast(LogFrequencyFilter.build(packed, pieces, _piece_bytes(pair_levels, pieces)))
    else:
        bits = cut(LogFrequencyFilter.table(packed, pieces, _piece_bytes(pair_levels, pieces), total // most_frequent + 1))
        pairs = spark.sparkContext.broadcast(_sorted_table(bits.where(F.length("h") > 0).select("h", "n")))

    def exact_counts(kinds, rows):
        n = _look_up(table.value, kinds)
        return n if broadcast_words else np.where(n > 0, n, _look_up(_row_counts(rows), kinds))

    def levels_of(kinds, rows):
        return level(exact_counts(kinds, rows)) if word_filter.value is None else word_filter.value.levels(word_key(kinds))

    def run(batches):
        for c, rows in chunks(batches, SPACE, lower=True, size=SCORED):
            token, before, start = _tokens(c)
            kinds, which = np.unique(token, return_inverse=True)
            estimate = LEVEL_COUNT[levels_of(kinds, rows)]
            previous = np.empty(len(token), np.float64)
            previous[1:] = estimate[which][:-1]
            previous[:1] = LEVEL_COUNT[levels_of(np.array([END]), rows)]
            distinct_pairs, pair_of = np.unique(pair_key(before, token), return_inverse=True)
            seen = LEVEL_COUNT[pairs.value.levels(distinct_pairs) if broadcast_pairs else level(_look_up(pairs.value, distinct_pairs))]
            # a context never seen leaves all weight to the word alone
            alone = np.where(previous > 0, 1 - pair_weight, 1.0) * ((estimate + 1) / uniform)[which]
            value = np.log10(alone) + _gain(seen[pair_of], previous, alone, pair_weight)
            exact = exact_counts(kinds, rows)
            base = np.log10((exact + 1) / uniform)[which]
            sums = [np.add.reduceat(x, start) if c.n else x for x in ((exact > 0)[which].astype(np.int64), base, value)]
            yield pa.RecordBatch.from_arrays([rows.column(2), rows.column(0), rows.column(3), longs(np.diff(np.append(start, len(token)))), longs(sums[0]), pa.array(sums[1]), pa.array(sums[2])], names)

    parts = numbered.mapInArrow(run, schema)
    if not broadcast_pairs:
        gains = _gains_by_shuffle(numbered, bits, pieces, levels_of, pairs, uniform, pair_weight)
        parts = parts.join(gains, "row", "left").withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0))).drop("gain")
    return parts.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _gain(seen: np.ndarray, previous: np.ndarray, alone: np.ndarray, pair_weight: float) -> np.ndarray:
    """What a pair adds to the log10 of its word's share."""
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(previous > 0, np.minimum(1.0, seen / previous), 0.0)
    return np.log10(1 + pair_weight * share / alone)


def _gains_by_shuffle(numbered: DataFrame, bits: DataFrame, pieces: int, levels_of, frequent, uniform: float, pair_weight: float) -> DataFrame:
    """(row, gain): sums over each row's pairs that are not frequent, asked of the pieces of the filter where those lie.

    A row asks once for each distinct pair, and its words' levels go with the question. A
    piece gets about PIECE_ENTRIES / (all entries) of all questions, as no pair that is left
    makes up a large share of the tokens.
    """

    def ask(batches):
        for c, rows in chunks(batches, SPACE, lower=True):
            token, before, start = _tokens(c)
            row = np.repeat(rows.column(2).to_numpy(), np.diff(np.append(start, len(token))))
            kinds, which = np.unique(token, return_inverse=True)
            own = levels_of(kinds, rows).astype(np.uint8)[which]
            ahead = np.empty_like(own)
            ahead[1:] = own[:-1]
            ahead[:1] = levels_of(np.array([END]), rows)
            h = pair_key(before, token)
            open_ = np.flatnonzero((ahead > 0) & (_look_up(frequent.value, h) == 0))
            order = open_[np.lexsort((h[open_], row[open_]))]
            t, r = h[order], row[order]
            at = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (r[1:] != r[:-1]))) if len(t) else np.zeros(0, np.int64)
            first = order[at]
            yield _packed(h[first], np.diff(np.append(at, len(t))), pieces, row=row[first], own=own[first], ahead=ahead[first])

    def answer(batches):
        piece, filled = None, None
        for b in batches:
            col = {name: b.column(k).to_pylist() for k, name in enumerate(b.schema.names)}
            asked: list[int] = []
            for i in range(b.num_rows):
                if col["piece"][i] != piece or col["bits"][i] is not None:
                    yield from gains(filled, col, asked)
                    asked, piece, filled = [], col["piece"][i], None
                if col["bits"][i] is not None:
                    filled = LogFrequencyFilter(np.frombuffer(col["bits"][i], np.uint8), 1)
                else:
                    asked.append(i)
            yield from gains(filled, col, asked)

    def gains(filled, col, asked):
        if filled is None or not asked:  # pairs of a piece without bits were never seen
            return
        kinds = {"h": np.uint64, "n": np.int64, "row": np.int64, "own": np.uint8, "ahead": np.uint8}
        h, n, row, own, ahead = (np.frombuffer(b"".join(col[x][i] for i in asked), kind) for x, kind in kinds.items())
        alone = (1 - pair_weight) * (LEVEL_COUNT[own] + 1) / uniform
        value = n * _gain(LEVEL_COUNT[filled.levels(h)], LEVEL_COUNT[ahead], alone, pair_weight)
        rows, which = np.unique(row, return_inverse=True)
        yield pa.RecordBatch.from_arrays([longs(rows), pa.array(np.bincount(which, value, len(rows)))], ["row", "gain"])

    asked = numbered.mapInArrow(ask, "piece int, h binary, n binary, row binary, own binary, ahead binary")
    met = bits.select("piece", "bits").unionByName(asked, allowMissingColumns=True).repartitionById(pieces, F.col("piece")).sortWithinPartitions("piece", F.col("bits").isNull())
    return met.mapInArrow(answer, "row long, gain double").groupBy("row").agg(F.sum("gain").alias("gain"))


def _keyed(counts: DataFrame, pieces: int) -> DataFrame:
    """Packed token counts under the keys that the filter knows words by."""

    def key(batches):
        for b in batches:
            if b.num_rows:
                yield _packed(word_key(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), b.column(1).to_numpy(zero_copy_only=False), pieces)

    return counts.select("h", "n").mapInArrow(key, "piece int, h binary, n binary")
