"""Vectorised text kernels that run inside Spark tasks.

A task receives Arrow batches of (id, text) rows; ``chunks`` slices them into pieces of
about ``CHUNK`` bytes, always on document borders, and every helper then works on whole
numpy arrays instead of on single words. Texts arrive as UTF-8 bytes (cast to binary in
the JVM), so nothing is decoded; null texts have no words.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U = np.uint64
_B, _C1, _C2, _GOLD = U(0x5851F42D4C957F2D), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)

SPACE = np.ones(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = False  # True: byte of a word [^\x20\x09-\x0D]
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True  # lower-cased [^\x00-\x2F\x3A-\x60\x7B-\x7F]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; returns a new array."""
    h = h ^ (h >> U(33))
    h *= _C1
    h ^= h >> U(29)
    h *= _C2
    h ^= h >> U(32)
    return h


PLACES = 32  # of bytes in a span, that are looked up
_A, _D = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)


def _placed(byte: np.ndarray, place: np.ndarray, family: int) -> np.ndarray:
    """What a byte at a place of its span adds: each pair is mixed by itself, so no pattern of letters cancels out."""
    return mix((byte.astype(np.uint64) + U(1 + 256 * family)) * _A + (place.astype(np.uint64) + U(1)) * _D)


_TABLES = [_placed(np.tile(np.arange(256), PLACES), np.repeat(np.arange(PLACES), 256), f) for f in (0, 1)]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hash of the bytes data[start:end] of each span; spans are in order and do not overlap. The two families are independent."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    place = np.arange(off[-1]) - np.repeat(off[:-1], size)
    byte = data[place + np.repeat(start, size)]
    far = np.flatnonzero(place >= PLACES)
    value = _TABLES[family][(np.minimum(place, PLACES - 1) << 8) | byte]
    if len(far):
        value[far] = _placed(byte[far], place[far], family)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix(total[off[1:]] - total[off[:-1]] + size.astype(np.uint64) * _GOLD)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _A + mix(right + _GOLD) * _B)


def run_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbouring values, put together from halves; none if there are fewer."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, part, width = None, 0, values, 1
    while at < k:
        if k & width:
            here = part[at : at + n]
            out = here.copy() if out is None else _joined(out, here)
            at += width
        if at < k:
            part = _joined(part[:-width], part[width:])
            width *= 2
    return mix(out + U(k * int(_GOLD) % (1 << 64)))


class Chunk:
    """Documents of one piece of a batch, with their words.

    data: bytes of all texts; off: each document's first byte, then the end; ws, we: each
    word's first byte and end; wptr: each document's first word, then the end.
    """

    def __init__(self, ids, data: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool):
        self.ids, self.n, self.off = ids, len(off) - 1, off
        self.data = LOWER[data] if lower else data
        word = table[self.data]
        if len(word):
            start, end = word.copy(), word.copy()
            start[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            cut = off[1:-1]
            cut = cut[(cut > 0) & (cut < len(word))]
            start[cut] = word[cut]
            end[cut - 1] = word[cut - 1]
            self.ws, self.we = np.flatnonzero(start), np.flatnonzero(end) + 1
        else:
            self.ws = self.we = np.zeros(0, np.int64)
        self.wptr = np.searchsorted(self.ws, off)
        self._wh: dict[int, np.ndarray] = {}

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.wptr)

    @property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @property
    def word_hash(self) -> np.ndarray:
        return self.word_hashes(0)

    def word_hashes(self, family: int) -> np.ndarray:
        if family not in self._wh:
            self._wh[family] = span_hashes(self.data, self.ws, self.we, family)
        return self._wh[family]

    def window_starts(self, k: int) -> np.ndarray:
        """First words of all runs of k words that lie in one document."""
        n = len(self.ws)
        if n < k:
            return np.zeros(0, np.int64)
        at = np.arange(n - k + 1)
        return at[at + k <= self.wptr[1:][self.word_doc[: n - k + 1]]]

    def windows(self, k: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of k words that lie in one document."""
        at = self.window_starts(k)
        return at, run_hashes(self.word_hashes(family), k)[at]

    def words(self, d: int) -> list[bytes]:
        span = slice(self.wptr[d], self.wptr[d + 1])
        raw, base = self.text(d), int(self.off[d])
        return [raw[a - base : b - base] for a, b in zip(self.ws[span].tolist(), self.we[span].tolist())]

    def text(self, d: int) -> bytes:
        return self.data[self.off[d] : self.off[d + 1]].tobytes()

    def doc_sum(self, per_word: np.ndarray) -> np.ndarray:
        """Sum over each document's words."""
        total = np.zeros(len(per_word) + 1, per_word.dtype)
        np.cumsum(per_word, out=total[1:])
        return total[self.wptr[1:]] - total[self.wptr[:-1]]


def _pieces(column: pa.Array, size: int = CHUNK):
    """(first row, end row, bytes, offsets) of pieces of about ``size`` bytes."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def trim() -> None:
    """Gives memory that is free by now back to the system: a Python worker serves many tasks, and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def chunks(batches, table: np.ndarray = SPACE, lower: bool = False, text: str = "text", size: int = CHUNK):
    """(Chunk, record batch slice) of each piece; the text column must be binary."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for a, b, data, off in _pieces(column, size):
            rows = batch.slice(a, b - a)
            yield Chunk(rows.column(0), data, off, table, lower), rows
        trim()


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Array of lists of longs, counts[i] values each."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), longs(values))

