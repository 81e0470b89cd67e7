"""Co-trained quality classifier: one view of a document's text, one of its metadata.

Each view has its own logistic model, fitted on labelled documents. In each round both
models label every document without a label, wherever the table holds it, and those that
one view is sure of teach the other: Spark sums, for each feature of the other view, the
documents called good and bad that have it. The log odds of these sums are one more input
of the other view's model, which is fitted again. Nothing but the sums reaches the driver,
so all unlabelled documents take part, however many they are. At last both views are
calibrated on labelled documents that neither has learnt from, and a weighted sum of their
log odds scores every document.

The models are fitted on at most about ``MOST_LABELS`` labelled documents, those whose
hashed ids come first; a quarter of them, by another hash, is kept for calibration. Which
words the text view looks at is decided by Spark: document frequencies by label over the
others, of which the ``WORDS`` most telling words go to the driver. All documents are
scored on their whole texts.

A document is good if its quality label is 1 and its toxic label is not 1. It is rejected
if its probability of being good is below a threshold, which is 0.5 or, if lower, the one
that ``KEEP_CLEAN`` of the good documents held out for calibration pass.

Defined cases: a null or empty text has no words, scores 0 and is rejected; a null source,
language or n_chars is a value of its own; repeated rows score alike, and each counts when
views teach each other; several labels of a document count as the worst; documents without
an id are without a label; without both kinds of labels every document that has words is
kept, with a null score; an empty table gives no rows; other columns are ignored, whatever
their names; a very long text is one piece of its task, some 60 bytes of memory for each
of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm import quality_rules
from talweg.llm._shared import cut, drop_cut, free_name
from talweg.llm._text import ALNUM, SPACE, Chunk, _pieces, lists, longs, trim

MOST_LABELS = 12_000
WORDS, LEAST_DOCS, LEAST_Z = 4096, 3, 3.0
ROUNDS, CONFIDENT = 3, 0.98
BINS = 16  # of a statistic, as features that can be taught
KEEP_CLEAN = 0.998
META = 1 << 10


def _views(rows: pa.RecordBatch, text_at: int):
    """(rows, raw chunk, lower-cased chunk) of each piece of a batch."""
    for a, b, data, off in _pieces(rows.column(text_at)):
        part = rows.slice(a, b - a)
        yield part, Chunk(None, data, off, SPACE, False), Chunk(None, data, off, ALNUM, True)


def _distinct_words(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct word hashes, end to end, and how many it has."""
    h, doc = c.word_hash, c.word_doc
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=c.n)


def metadata_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Three feature numbers below META for each document: of its source, its language, and its stated length."""
    import zlib

    code = lambda kind, x: zlib.crc32(f"{kind}{'' if x is None else '=' + str(x)}".encode()) % META
    size = [None if n is None else int(4 * np.log2(max(1, n))) for n in n_chars]
    return np.array([[code("source", s), code("lang", g), code("size", z)] for s, g, z in zip(source, lang, size)], np.int64).reshape(-1, 3)


@dataclass
class Sparse:
    """Rows of present features plus dense columns."""

    feature: np.ndarray
    count: np.ndarray
    dense: np.ndarray
    width: int

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def take(self, keep: np.ndarray) -> "Sparse":
        return Sparse(self.feature[np.repeat(keep, self.count)], self.count[keep], self.dense[keep], self.width)


@dataclass
class Logistic:
    """Logistic model with a ridge penalty, fitted by Adam on all rows at once."""

    weight: np.ndarray
    dense: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def logit(self, x: Sparse) -> np.ndarray:
        return np.bincount(x.row, self.weight[x.feature], len(x.count)) + np.clip((x.dense - self.mean) / self.scale, -8, 8) @ self.dense + self.bias

    @classmethod
    def fit(cls, x: Sparse, y: np.ndarray, ridge: float = 3e-4, steps: int = 250, rate: float = 0.08) -> "Logistic":
        mean, scale = x.dense.mean(0), x.dense.std(0) + 1e-6
        dense, row, n = np.clip((x.dense - mean) / scale, -8, 8), x.row, len(y)
        w = np.zeros(x.width + dense.shape[1] + 1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            z = np.bincount(row, w[: x.width][x.feature], n) + dense @ w[x.width : -1] + w[-1]
            r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            g = np.concatenate([np.bincount(x.feature, r[row], x.width), dense.T @ r, [r.sum()]])
            g[:-1] += ridge * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        return cls(w[: x.width], w[x.width : -1], float(w[-1]), mean, scale)


@dataclass
class View:
    """A logistic model, one of whose inputs is what the other view has told: log odds of each feature, zero before the first round."""

    model: Logistic
    told: np.ndarray

    def logit(self, x: Sparse) -> np.ndarray:
        return self.model.logit(with_told(x, self.told))

    @classmethod
    def fit(cls, x: Sparse, y: np.ndarray, told: np.ndarray) -> "View":
        return cls(Logistic.fit(with_told(x, told), y), told)


def with_told(x: Sparse, told: np.ndarray) -> Sparse:
    return Sparse(x.feature, x.count, np.column_stack([x.dense, np.bincount(x.row, told[x.feature], len(x.count))]), x.width)


@dataclass
class Looks:
    """What the text view looks at: sorted hashes of words, and the borders of each statistic's bins."""

    words: np.ndarray
    edges: list[np.ndarray]

    def text(self, words: np.ndarray, count: np.ndarray, stats: np.ndarray) -> Sparse:
        """Places of present words end to end, how many a document has, and its statistics, as a view: words and bins, and the statistics themselves."""
        n, at, bins = len(count), len(self.words), []
        for k, e in enumerate(self.edges):
            bins.append(at + np.searchsorted(e, stats[:, k]))
            at += len(e) + 1
        row = np.concatenate([np.repeat(np.arange(n), count), np.repeat(np.arange(n), len(bins))])
        feature = np.concatenate([words, np.stack(bins, 1).ravel() if n else np.zeros(0, np.int64)])
        return Sparse(feature[np.argsort(row, kind="stable")], count + len(bins), stats, at)


def metadata_view(meta: np.ndarray) -> Sparse:
    return Sparse(meta.ravel(), np.full(len(meta), meta.shape[1]), np.zeros((len(meta), 0)), META)


@dataclass
class Model:
    looks: Looks
    views: dict[str, View]
    mix: np.ndarray  # calibration: weights of both logits, and bias
    threshold: float

    def odds(self, text: Sparse, meta: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.views["text"].logit(text), self.views["meta"].logit(meta)
        return a, b, np.clip(a, -12, 12) * self.mix[0] + np.clip(b, -12, 12) * self.mix[1] + self.mix[2]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def lessons(views: dict[str, View], text: Sparse, meta: Sparse) -> dict[str, np.ndarray]:
    """What each view gets told by the other: for each of its features, and at last for none, how many documents that have it the other calls good and bad."""
    x, out = {"text": text, "meta": meta}, {}
    for name, other in (("text", "meta"), ("meta", "text")):
        p = _sigmoid(views[name].logit(x[name]))
        out[other] = np.stack([np.append(np.bincount(x[other].feature[np.repeat(sure, x[other].count)], minlength=x[other].width), sure.sum()) for sure in (p >= CONFIDENT, p <= 1 - CONFIDENT)], 1)
    return out


def log_odds(sums: np.ndarray) -> np.ndarray:
    """Of each feature, from lessons(); zeros where documents of one kind alone are known."""
    if not sums[-1].all():
        return np.zeros(len(sums) - 1)
    share = np.log((sums[:-1] + 1) / (sums[-1] + 2))
    return share[:, 0] - share[:, 1]


def cotrain(text: Sparse, meta: Sparse, y: np.ndarray, calibrate: np.ndarray, teach: Callable[[dict[str, View]], dict[str, np.ndarray]], rounds: int = ROUNDS) -> tuple[dict[str, View], np.ndarray, float]:
    """Models of both views, calibration and threshold, from labelled rows; those of ``calibrate`` are not learnt from. teach: views to lessons() of all unlabelled documents."""
    learn, x = ~calibrate, {"text": text, "meta": meta}
    views = {n: View.fit(v.take(learn), y[learn], np.zeros(v.width)) for n, v in x.items()}
    for _ in range(rounds):
        told = teach(views)
        views = {n: View.fit(v.take(learn), y[learn], log_odds(told[n])) for n, v in x.items()}
    # Platt: one logistic model of the two logits
    rows = calibrate if calibrate.sum() >= 100 else np.ones(len(y), bool)
    logits = np.stack([np.clip(views[n].logit(v.take(rows)), -12, 12) for n, v in x.items()], 1)
    none = Sparse(np.zeros(0, np.int64), np.zeros(int(rows.sum()), np.int64), logits, 0)
    platt = Logistic.fit(none, y[rows], ridge=1e-4, steps=400)
    mix = np.append(platt.dense / platt.scale, platt.bias - (platt.dense * platt.mean / platt.scale).sum())
    clean = np.sort(_sigmoid(logits @ mix[:2] + mix[2])[y[rows] == 1])
    return views, mix, float(min(0.5, clean[int((1 - KEEP_CLEAN) * len(clean))]))


def _labelled(labels: DataFrame, most_labels: int) -> DataFrame:
    """(doc_id, label, calibrate): a bounded sample of the labelled documents."""
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), 1).otherwise(0)
    got = quality_rules.labelled_sample(labels.where("quality is not null").select("doc_id", good.alias("good")), "good", most_labels)
    doc_id = F.col("doc_id").cast("long")
    return got.select(doc_id.alias("doc_id"), F.col("label").cast("int").alias("label"), (F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(4)) == 0).alias("calibrate"))


def _columns(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, lang, n_chars; what a table lacks is null."""
    have = lambda c, t: (F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), have("source", "string"), have("lang", "string"), have("n_chars", "long"))


def _looked_at(raw: Chunk, low: Chunk, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the listed words that each document has, end to end, how many those are, and its statistics."""
    at = np.minimum(np.searchsorted(words, low.word_hash), max(0, len(words) - 1))
    hit = words[at] == low.word_hash if len(words) else np.zeros(len(at), bool)
    doc, place = np.divmod(np.unique(low.word_doc[hit] * max(1, len(words)) + at[hit]), max(1, len(words)))
    return place, np.bincount(doc, minlength=raw.n), quality_rules.features(quality_rules.statistics(raw))


def _rows_of(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def looked_at(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """doc_id, has_words, words (places of the listed ones), stats and meta of every row: what the models need of it."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    names = ["doc_id", "has_words", "words", "stats", "meta"]

    def look(batches):
        for batch in batches:
            for rows, raw, low in _views(batch, 1):
                place, count, stats = _looked_at(raw, low, sent.value)
                meta = metadata_features(*(rows.column(k).to_pylist() for k in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(raw.n_words > 0), lists(place, count), _rows_of(stats), _rows_of(meta)], names)

    return _columns(docs).mapInArrow(look, "doc_id long, has_words boolean, words array<long>, stats array<double>, meta array<long>")


def _of_rows(b: pa.RecordBatch, looks: Looks) -> tuple[Sparse, Sparse]:
    """Both views of rows of looked_at()."""
    words, stats, meta = (b.column(b.schema.get_field_index(x)) for x in ("words", "stats", "meta"))
    flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
    count = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return looks.text(flat(words), count, flat(stats).reshape(len(count), -1)), metadata_view(flat(meta).reshape(len(count), -1))


def _teach(free: DataFrame, looks: Looks, views: dict[str, View]) -> dict[str, np.ndarray]:
    """lessons() of all rows of looked_at(); the driver gets a row for each feature."""
    sent = free.sparkSession.sparkContext.broadcast((looks, views))

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for name, x in lessons(sent.value[1], *_of_rows(b, sent.value[0])).items():
                    total[name] = total[name] + x if name in total else x
        for name, x in total.items():
            at = np.flatnonzero(x.any(1))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), longs(at), longs(x[at, 0]), longs(x[at, 1])], ["view", "feature", "good", "bad"])

    got = free.mapInArrow(sums, "view string, feature long, good long, bad long").groupBy("view", "feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    out = {name: np.zeros((len(v.told) + 1, 2)) for name, v in views.items()}
    for r in got:
        out[r.view][r.feature] = r.good, r.bad
    sent.unpersist()
    return out


def _telling(seen: DataFrame, bad: int, good: int) -> np.ndarray:
    """Sorted hashes of the words whose share of documents differs most between the labels."""
    df = seen.select("label", F.explode("words").alias("h")).groupBy("h").agg(F.sum("label").alias("g"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS)
    pg, pb, p = F.col("g") / good, (F.col("n") - F.col("g")) / bad, F.col("n") / (good + bad)
    z = F.abs(pg - pb) / F.sqrt(p * (1 - p) * (1 / good + 1 / bad) + 1e-12)
    telling = df.select("h", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "h").limit(WORDS)
    return np.sort(np.array([r.h for r in telling.collect()], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> tuple[Model | None, DataFrame | None]:
    """The fitted model, None without both kinds of labels, and looked_at() of all rows, written."""
    sample = cut(_labelled(labels, most_labels))
    picked = _columns(docs).join(F.broadcast(sample), "doc_id")  # most_labels rows, about
    names = ["doc_id", "label", "calibrate", "meta", "stats", "words"]

    def look(batches):
        for batch in batches:
            for rows, raw, low in _views(batch, 1):
                stats = quality_rules.features(quality_rules.statistics(raw))
                meta = metadata_features(*(rows.column(k).to_pylist() for k in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(5), rows.column(6), _rows_of(meta), _rows_of(stats), lists(*_distinct_words(low))], names)

    seen = picked.select("doc_id", "text", "source", "lang", "n_chars", "label", "calibrate").mapInArrow(look, "doc_id long, label int, calibrate boolean, meta array<long>, stats array<double>, words array<long>")
    seen = cut(seen)
    kinds = {(r.label, r.calibrate): r.n for r in seen.groupBy("label", "calibrate").agg(F.count(F.lit(1)).alias("n")).collect()}
    apart = len(kinds) == 4  # both labels on both sides
    bad, good = (kinds.get((k, False), 0) + (0 if apart else kinds.get((k, True), 0)) for k in (0, 1))
    if min(bad, good) < 5:
        return None, None
    words = _telling(seen.where("not calibrate") if apart else seen, bad, good)
    listed = F.array_intersect("words", F.lit(words.view(np.int64).tolist()) if len(words) else F.array().cast("array<long>"))
    got = seen.select("doc_id", "label", "calibrate", "meta", "stats", listed.alias("words")).orderBy("doc_id", "label").toPandas()
    drop_cut(seen)
    n = len(got)
    stats = np.array(got["stats"].tolist(), float).reshape(n, -1)
    flat = np.concatenate([np.asarray(x, np.int64) for x in got["words"]])
    y, calibrate = got["label"].to_numpy(float), got["calibrate"].to_numpy(bool) & apart
    edges = [np.unique(np.quantile(stats[~calibrate, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(stats.shape[1])]
    looks = Looks(words, edges)
    text = looks.text(np.searchsorted(words, flat.view(np.uint64)), got["words"].map(len).to_numpy(), stats)
    meta = metadata_view(np.array(got["meta"].tolist(), np.int64).reshape(n, -1))
    every = cut(looked_at(docs, words))
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    free = cut(every.join(known, "doc_id", "left_anti").select("words", "stats", "meta"))
    views, mix, threshold = cotrain(text, meta, y, calibrate, lambda views: _teach(free, looks, views))
    drop_cut(free)
    drop_cut(sample)
    return Model(looks, views, mix, threshold), every


def score(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id, score (probability of being good), text_score and meta_score (the views' own), and kept, of every row."""
    names = ["doc_id", "score", "text_score", "meta_score", "kept"]
    schema = "doc_id long, score double, text_score double, meta_score double, kept boolean"
    model, every = train(docs, labels, most_labels)
    if model is None:
        none = F.lit(None).cast("double")
        return looked_at(docs, np.zeros(0, np.uint64)).select("doc_id", *(none.alias(x) for x in names[1:4]), F.col("has_words").alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            scores, kept = _judge(sent.value, b.column(1).to_numpy(zero_copy_only=False), *_of_rows(b, sent.value.looks))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, scores), pa.array(kept)], names)

    return every.mapInArrow(run, schema)


def _judge(m: Model, has_words: np.ndarray, text: Sparse, meta: Sparse) -> tuple[list[np.ndarray], np.ndarray]:
    """score, text_score and meta_score of each document, and whether it is kept."""
    a, b, both = m.odds(text, meta)
    p = np.where(has_words, _sigmoid(both), 0.0)
    return [p, _sigmoid(a), _sigmoid(b)], has_words & (p >= m.threshold)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; each row is judged by itself, whatever its doc_id."""
    model, every = train(docs, labels)
    if every is not None:
        drop_cut(every)
    trim()  # the driver's own, after the fit
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index("text")
    views = _columns(docs)
    extra = {c: free_name(f"_{c}", names) for c in ("source", "lang", "n_chars")}

    def run(batches):
        m = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            field = batch.schema.field(at)
            for rows, raw, low in _views(batch.set_column(at, pa.field("text", pa.binary()), batch.column(at).cast(pa.binary())), at):
                kept = raw.n_words > 0
                if m is not None:
                    meta = metadata_features(*(rows.column(len(names) + k).to_pylist() for k in range(3)))
                    kept = _judge(m, kept, m.looks.text(*_looked_at(raw, low, m.looks.words)), metadata_view(meta))[1]
                rows = pa.RecordBatch.from_arrays(rows.columns[: len(names)], schema=pa.schema([rows.schema.field(k) for k in range(len(names))])).filter(pa.array(kept))
                yield rows.set_column(at, field, rows.column(at).cast(field.type))

    return docs.select("*", *((F.col(c) if c in names else F.lit(None)).cast(views.schema[c].dataType).alias(x) for c, x in extra.items())).mapInArrow(run, docs.schema)
