"""Quality rules: document statistics, and boosted trees over them.

Statistics are exact and come from whole texts. The trees are fitted on the driver from a
bounded sample of labelled documents (at most ``MOST_LABELS``, the first ones in the order
of a hash of their ids); scoring runs in the tasks on the trees flattened into node
arrays. Chosen features may only push the score one way (monotonic constraints).

Defined cases: a null or empty text has zero in every statistic and fails the base rule;
repeated rows are scored alike; without labels of both kinds there are no trees and the
base rule alone decides; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm._text import SPACE, U, Chunk, chunks, longs, mix, span_hashes

MOST_LABELS = 20_000
MIN_WORDS = 50
KEEP_FROM = 0.15  # least probability of good quality that is kept
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that start a code point
# statistics, with the direction in which each may move the score (0: either)
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "upper_share": -1, "digit_share": -1, "mark_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "words_per_line": 0}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct"]


def _byte_sum(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _found_before(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash: does its document have it earlier; does it have it twice or more."""
    key = mix(h + (doc.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    again, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    twice[order] = both
    return again, twice


def statistics(c: Chunk) -> dict[str, np.ndarray]:
    """Exact counts of each document of the chunk."""
    data, off, doc = c.data, c.off, c.word_doc
    lead = _LEAD[data]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    out = {"n_words": c.n_words, "word_chars": c.doc_sum(before[c.we] - before[c.ws]), "n_symbols": _byte_sum(_SYMBOL[data], off)}
    # lines: between line feeds and document borders
    feed = np.flatnonzero(data == 10)
    ends = np.concatenate([feed, off[1:]])
    starts = np.concatenate([feed + 1, off[:-1]])
    ends.sort(), starts.sort()
    line_doc = np.searchsorted(off, starts, "right") - 1
    # an empty document's line starts where the next document does: it has no word and is left out
    first = np.searchsorted(c.ws, starts)
    full = (np.searchsorted(c.ws, ends) > first) & (ends > starts)
    starts, ends, line_doc = starts[full], ends[full], line_doc[full]
    again, _ = _found_before(line_doc, span_hashes(data, starts, ends))
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=c.n)
    at, h = c.windows(3)
    _, twice = _found_before(doc[at], h)
    covered = np.zeros(len(c.ws), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out["n_repeat_words"] = c.doc_sum(covered.astype(np.int64))
    again, _ = _found_before(doc, c.word_hash)
    out |= {"n_chars": _byte_sum(lead, off), "n_upper": _byte_sum(_UPPER[data], off), "n_digits": _byte_sum(_DIGIT[data], off), "n_marks": _byte_sum(_MARK[data], off), "n_lines": np.bincount(line_doc, minlength=c.n), "n_distinct": c.n_words - c.doc_sum(again.astype(np.int64))}
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Matrix of FEATURES."""
    words, chars, lines = (np.maximum(1, s[k]).astype(float) for k in ("n_words", "n_chars", "n_lines"))
    columns = [np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_distinct"] / words, words / lines]
    return np.stack(columns, 1)


@dataclass
class Trees:
    """Boosted trees as flat arrays; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality; all rows go down all trees one level at a time."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Newton-boosted trees for log loss, with histogram splits.

    A split on a feature with sign s is refused if its right value is on the wrong side of
    its left one; the children's values then stay on their sides of the middle.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    f = np.full(len(y), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows, g, h, low, high, level) -> int:
        G, H = g[rows].sum(), h[rows].sum()
        me = len(nodes)
        nodes.append([0, np.inf, me, me, float(np.clip(-G / (H + ridge), low, high)) * rate])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(G - gl) / (H - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                gain[(n < least) | (len(rows) - n < least) | (signs[j] * (vr - vl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, vl[k], vr[k]))
        if best[1]:
            j, k, vl, vr = best[1]
            left, mid = binned[rows, j] <= k, (vl + vr) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[signs[j]]
            a = grow(rows[left], g, h, *bounds[0], level + 1)
            b = grow(rows[~left], g, h, *bounds[1], level + 1)
            nodes[me][:4] = [j, float(edges[j][k]), a, b]
        return me

    every = np.arange(len(y))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        start = len(nodes)
        roots.append(start)
        grow(every, q - y, q * (1 - q), -np.inf, np.inf, 0)
        part = _flat(nodes[start:], [0], 0.0, depth, start)
        f = f + part.score(x)
    return _flat(nodes, roots, base, depth)


def _flat(nodes: list[list], roots: list[int], base: float, depth: int, shift: int = 0) -> Trees:
    cols = list(zip(*nodes))
    return Trees(np.array(cols[0]), np.array(cols[1]), np.array(cols[2]) - shift, np.array(cols[3]) - shift, np.array(cols[4]), np.array(roots), base, depth)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id with COUNTS and MORE."""
    names = ["doc_id", *COUNTS, *MORE]

    def count(batches):
        for c, rows in chunks(batches):
            s = statistics(c)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(longs(s[k]) for k in names[1:])], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(count, ", ".join(f"{k} long" for k in names))


def labelled_sample(labels: DataFrame, label: str, most: int = MOST_LABELS) -> DataFrame:
    """At most about ``most`` labelled ids, the same ones each time: a hash of the id against a share."""
    n = labels.count()
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return usable.groupBy("doc_id").agg(F.min(label).alias("label"))  # two labels of one document: the worse one


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Trees | None:
    """Trees from the labelled sample's documents; None without both labels."""
    sample = labelled_sample(labels, "quality", most).where("label in (0, 1)")
    picked = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "label")), "doc_id")  # the sample has ``most`` rows at most, about
    got = document_statistics(picked.select("doc_id", "text")).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    y = got["label"].to_numpy(float)
    if len(got) < 50 or y.min() == y.max():
        return None
    x = features({k: got[k].to_numpy() for k in (*COUNTS, *MORE)})
    return fit(x, y, list(FEATURES.values()))


def judge(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, most: int = MOST_LABELS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the score (probability of good quality; null without trees)."""
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))
    names = ["doc_id", *COUNTS, "base_failed", "kept", "score"]

    def run(batches):
        for c, rows in chunks(batches):
            s = statistics(c)
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            score = None if trees.value is None else 1 / (1 + np.exp(-trees.value.score(features(s))))
            kept = ~failed if score is None else ~failed & (score >= keep_from)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(longs(s[k]) for k in COUNTS), pa.array(failed), pa.array(kept), pa.nulls(c.n, pa.float64()) if score is None else pa.array(score)], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, ", ".join(f"{k} long" for k in ("doc_id", *COUNTS)) + ", base_failed boolean, kept boolean, score double")
