"""What several operators share: cut tables, and bit filters of a bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.lineage import cut, drop_cut, scratch
from talweg.llm._text import U, mix

_GOLD = U(0x9E3779B97F4A7C15)


def free_name(name: str, taken: list[str]) -> str:
    """name, or the first of name_, name__, ... that no column has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on the session's Python workers get texts by a few MB: by rows alone a batch may hold a whole split, in the worker and twice in the JVM. A limit that the session has stays."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, size)


class BitFilter:
    """Bloom filter of longs: 2**pieces_log2 pieces, each built by one task.

    The size follows the number of entries up to ``max_bytes``; beyond it the share of
    false positives rises, and the caller must stay right with those.
    """

    PROBES = 4

    def __init__(self, bits: np.ndarray, pieces: int):
        self.bits, self.pieces = bits, pieces

    @staticmethod
    def places(h: np.ndarray, piece_bits: int, probes: int):
        for i in range(probes):
            yield (mix(h + U((i + 1) * int(_GOLD) % (1 << 64))) % U(piece_bits)).astype(np.int64)

    def __contains__(self, h: int) -> bool:
        return bool(self.might_contain(np.array([h], np.uint64))[0])

    def might_contain(self, h: np.ndarray) -> np.ndarray:
        if not len(self.bits):
            return np.zeros(len(h), bool)
        piece_bits = len(self.bits) * 8 // self.pieces
        base = (h % U(self.pieces)).astype(np.int64) * piece_bits
        out = np.ones(len(h), bool)
        for place in self.places(h, piece_bits, self.PROBES):
            at = base + place
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out

    @classmethod
    def build(cls, df: DataFrame, column: str, entries: int, max_bytes: int = 32 << 20, bits_per_entry: int = 12) -> "BitFilter":
        """Filter of df's column (longs). The driver gets max_bytes at most."""
        pieces = 16
        piece = int(min(max_bytes, max(1 << 12, entries * bits_per_entry // 8 + 1)) // pieces + 1) * 8
        probes = cls.PROBES

        def fill(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                part = (h % U(pieces)).astype(np.int64)
                for p in np.unique(part).tolist():
                    bits = held.setdefault(p, np.zeros(piece, bool))
                    for place in cls.places(h[part == p], piece, probes):
                        bits[place] = True
            for p, bits in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["p", "bits"])

        rows = df.select(F.col(column).cast("long").alias("h")).where("h is not null")
        made = rows.repartition(pieces, F.pmod(F.col("h"), F.lit(pieces))).mapInArrow(fill, "p int, bits binary")
        bits = np.zeros(pieces * piece // 8, np.uint8)
        for row in made.toLocalIterator():
            at = row.p * piece // 8
            bits[at : at + piece // 8] |= np.frombuffer(row.bits, np.uint8)
        return cls(bits, pieces)


MOST_FILTERED = 20_000_000  # entries of a bit filter of rows


def picker(found: DataFrame, key: str) -> Callable[[bool], Callable]:
    """Filters of batches whose last column is a row's key (long): pick(True) keeps those that may be in found, pick(False) the others.

    One bit filter of a bounded size tells; with more than MOST_FILTERED entries all are kept by pick(True).
    """
    n = found.count()
    sent = found.sparkSession.sparkContext.broadcast(BitFilter.build(found, key, n) if n <= MOST_FILTERED else None)

    def pick(wanted: bool):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    maybe = np.ones(b.num_rows, bool) if sent.value is None else sent.value.might_contain(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64))
                    yield b.filter(pa.array(maybe == wanted))

        return run

    return pick


__all__ = ["BitFilter", "cut", "drop_cut", "free_name", "picker", "scratch", "small_batches"]
