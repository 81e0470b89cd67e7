"""Operators 11 to 13 against plain statements of their contracts."""

import random
from collections import Counter

import numpy as np
import pytest

import brute
from talweg.llm import embedding_whitening, line_dedup, merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, doc long, row long, pos long, key string, tree string, bucket long, n long"


def frame(spark, rows, parts=3):
    full = [(*r, 1, 2, 3, 4, "k", "t", 5, 6) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents():
    rnd = random.Random(11)
    line = lambda n: " ".join(rnd.choice(["Alpha", "beta", "Γδ", "x" * 7, "ß"]) for _ in range(n))
    shared = [line(14) for _ in range(6)] + ["short line", "e" * 39, "é" * 40, "Q" * 40]
    rows = []
    for k in range(150):
        lines = [line(rnd.randint(1, 16)) for _ in range(rnd.randint(0, 5))]
        lines += [rnd.choice(["", " ", "\t\x0b"]) + rnd.choice([x, x.lower(), x.upper()]) + rnd.choice(["", "\r", " \x0c"]) for x in rnd.sample(shared, rnd.randint(0, 6))]
        lines += [shared[0]] * rnd.choice([0, 1, 1, 3])
        rnd.shuffle(lines)
        text = "\n".join(lines)
        rows.append((k, text, rnd.choice(["en", "de", None, "", "é", "ab"]), rnd.choice(["s", None]), rnd.choice([None, len(text)])))
    rows += [(rows[5][0], "other\n" + shared[0], "en", None, None), rows[7], rows[7], (500, None, "en", "s", None), (501, "", None, None, 0), (502, "\n\n", "zz", "s", 2), (None, "no id\n" + shared[1], "en", "s", 3), (None, None, "en", "s", None)]
    rows.append((503, ("y" * 60_000 + "\n") * 30 + shared[2], "en", "long", 1))  # a very long text with very long lines
    return rows


@pytest.mark.parametrize("length, least", [(40, 5), (1, 2), (10, 60)])
def test_line_dedup(spark, documents, length, least):
    want = Counter((i, n, g, brute.sha(kept)) for i, n, g, kept in brute.line_dedup([r[:2] for r in documents], length, least))
    got = line_dedup.report(frame(spark, documents), length, least)
    assert Counter(map(tuple, got.collect())) == want
    cut = line_dedup.drop_lines(frame(spark, documents), length, least)
    assert cut.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    rows = [(r.doc_id, r.text, r.n_chars) for r in cut.collect()]
    kept = brute.line_dedup([r[:2] for r in documents], length, least)
    assert Counter((i, t or "") for i, t, _ in rows) == Counter((i, t) for i, _, _, t in kept)


def test_line_dedup_of_keys_that_span_ranges(spark, monkeypatch):
    """One key in most documents, over many ranges and small batches; repeated rows and rows of one id among them."""
    hot, warm = "This line stands in very many of the documents here", "another line of forty letters, in exactly five docs"
    rows = [(k % 170 if k % 3 else k, f"{hot}\nrow {k}\n{hot.upper()} ", "en", "s", 1) for k in range(400)]
    rows += [(1000 + k, f"{warm}\n{hot}" if k < 5 else warm[:-1], "en", "s", 1) for k in range(6)]
    rows += rows[:50]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = line_dedup.report(frame(spark, rows, 5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter(map(tuple, got)) == Counter((i, n, g, brute.sha(kept)) for i, n, g, kept in brute.line_dedup([r[:2] for r in rows]))


def test_line_dedup_of_rows_without_id(spark):
    """One of the rows without id keeps the line, if no row with an id holds it; equal texts are one document."""
    line = "a line of more than forty letters that is shared by all"
    rows = [(None, f"{line}\n{k % 6}", "en", "s", 1) for k in range(12)]
    got = line_dedup.report(frame(spark, rows)).collect()
    assert sorted(r.n_dropped for r in got) == [0, 0] + [1] * 10
    got = line_dedup.report(frame(spark, [*rows, (-5, line, "en", "s", 1)])).collect()
    assert {(r.doc_id, r.n_dropped) for r in got} == {(None, 1), (-5, 0)}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.report(frame(spark, [])).count() == 0 and line_dedup.drop_lines(frame(spark, [])).count() == 0
    assert [tuple(r)[1:3] for r in line_dedup.report(frame(spark, [(1, None, "en", "s", 1), (2, "", "en", "s", 1)])).collect()] == [(1, 0), (1, 0)]


def test_manifest(spark, documents):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in documents]
    got = merkle_manifest.manifest(frame(spark, documents))
    assert Counter(map(tuple, got.collect())) == Counter(brute.manifest(rows))


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_of_small_buckets(spark, documents, monkeypatch, levels):
    """Several climbs: buckets of 8 and 64 leaves give the same tree."""
    import inspect

    import talweg.llm.merkle_manifest as m

    source = inspect.getsource(m).replace("FAN, LEVELS = 8, 4", f"FAN, LEVELS = 8, {levels}")
    small = {"__name__": "__main__"}  # so that tasks get its functions by value
    exec(compile(source, "small buckets", "exec"), small)
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in documents]
    assert Counter(map(tuple, small["manifest"](frame(spark, documents)).collect())) == Counter(brute.manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9])
def test_manifest_of_few_rows(spark, n):
    docs = [(k, f"Text {k}", "en", "s", 1) for k in range(n)]
    got = merkle_manifest.manifest(frame(spark, docs))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(brute.manifest([(r[0], r[3], r[2], r[4], r[1]) for r in docs]))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, component int, label int").repartition(3) if rows else spark.createDataFrame([], "vec_id long, embedding array<float>, x string, component int, label int")


def check_whitening(got, rows, k=8):
    """Rows (id, vector) against a dense eigenproblem; rows of equal id stand together."""
    x = np.array([[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    c = ((n * x - s) / n).astype(float)
    values, w = np.linalg.eigh(c.T @ c / n)
    values, w = values[::-1], w[:, ::-1]
    z = {}
    for r in got:
        z.setdefault(r.component, {}).setdefault(r.vec_id, set()).add(r.whitened)
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
        assert r.deviation in {d for (i, _), d in zip(rows, deviation) if i == r.vec_id}
    assert sorted(z) == list(range(1, min(k, int((values > 1e-9 * values[0]).sum())) + 1))
    for m, by_id in z.items():
        want = c @ w[:, m - 1] / np.sqrt(values[m - 1])
        flat = [(i, want[j]) for j, (i, _) in enumerate(rows)]
        errors = [max(min(abs(sign * v - a) for a in by_id[i]) for i, v in flat) for sign in (1, -1)]
        assert min(errors) < 1e-7


def test_whitening(spark):
    rnd = np.random.default_rng(4)
    good = [(k, (rnd.standard_normal(20) * np.linspace(1, 2, 20) + 30 * (k % 2)).astype(np.float32).tolist()) for k in range(120)]
    good += [good[3], (None, good[5][1]), (7, good[9][1])]  # repeated, without an id, an id twice
    bad = [(900, None), (901, []), (902, [None] * 20), (903, [*good[0][1][:19], None]), (904, [*good[0][1][:19], float("nan")]), (905, [*good[0][1][:19], float("-inf")]), (906, [1.0] * 19)]
    got = embedding_whitening.whiten(vectors(spark, [(*r, "x", 1, 2) for r in good + bad]))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(got.collect(), good)


def test_whitening_needs_passes_and_restarts(spark):
    """More dimensions than the basis may hold, and a flat spectrum behind a few large values."""
    rnd = np.random.default_rng(5)
    good = [(k, (rnd.standard_normal(90) * np.append([9, 7, 5], np.ones(87))).tolist()) for k in range(300)]
    rows = embedding_whitening.fixed_point(vectors(spark, [(*r, "x", 1, 2) for r in good]))
    model = embedding_whitening.fit(rows, k=3, block=4, most=24)
    assert model.passes > 6 and (model.residuals <= 1e-13 * model.values[0]).all()
    check_whitening(embedding_whitening.transform(rows, model, embedding_whitening.identity_error(rows, model)).collect(), [(k, np.float32(v)) for k, v in good], 3)


def test_whitening_of_little(spark):
    """Empty, one row, constant rows, few directions with variance, and entries beyond the limit."""
    assert embedding_whitening.whiten(vectors(spark, [])).count() == 0
    assert embedding_whitening.whiten(vectors(spark, [(1, [1.0, 2.0], "x", 1, 2)])).count() == 0
    assert embedding_whitening.whiten(vectors(spark, [(k, [1.0, 2.0], "x", 1, 2) for k in range(5)])).count() == 0
    few = [(k, [float(k), float(k * k), 2.0 * k]) for k in range(9)]
    check_whitening(embedding_whitening.whiten(vectors(spark, [(*r, "x", 1, 2) for r in few])).collect(), few)
    got = embedding_whitening.whiten(vectors(spark, [(1, [1e30, 0.0], "x", 1, 2), (2, [-1e30, 1.0], "x", 1, 2)])).collect()
    assert [r.deviation for r in got] == [None, None] and all(np.isfinite(r.whitened) for r in got)


