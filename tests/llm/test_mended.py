"""Words that simple hashes take for equal, rows without ids, large benchmarks, very long texts, and an index that outlives its session."""

import random

import numpy as np
import pytest

import brute
from talweg.llm import chat_format, decontamination, lm_scoring, minhash_dedup, quality_classifier, quality_rules, source_mixing, substring_dedup
from talweg.llm._text import run_hashes, span_hashes
from talweg.llm.components import union_find
from test_operators import empty, frame, prose


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(k).count("1") + flip) & 1] for k in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, 1)) for n in (1024, 4096)]


@pytest.mark.parametrize("family", [0, 1])
def test_hashes_of_patterns_and_runs_differ(family):
    words = [w for pair in PAIRS for w in pair] + ["a" * k for k in range(1, 200)] + ["a" * k + "b" + "a" * (80 - k) for k in range(81)] + ["", ""]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    h = span_hashes(data, end - [len(w) for w in words], end, family)
    assert len(set(h.tolist())) == len(set(words))
    a, b = np.uint64(3), np.uint64(1 << 63)
    values = np.array([{"a": a, "b": b}[x] for x in PAIRS[0][0] + PAIRS[0][1]], np.uint64)
    for k in (1, 2, 3, 5, 10, 13, 20, 64, 1024):
        runs = {}
        for at, x in enumerate(run_hashes(values, k).tolist()):
            assert runs.setdefault(x, tuple(values[at : at + k].tolist())) == tuple(values[at : at + k].tolist())
        assert len(runs) == len({tuple(values[at : at + k].tolist()) for at in range(len(values) - k + 1)})
    assert len(run_hashes(values[:4], 5)) == 0


def test_words_of_patterns_are_told_apart(spark):
    """Documents that differ in such a word only: operators 3, 5, 8 and 9 against brute force, and the classifier's words."""
    rows = []
    for k, (x, y) in enumerate(PAIRS):
        same = " ".join(f"s{k}_{j}" for j in range(19))
        rows += [(10 * k, f"{x} {same}"), (10 * k + 1, f"{y} {same}"), (10 * k + 2, f"{same} {x}\n{same} {y}"), (10 * k + 3, f"{x}"), (10 * k + 4, f"{y}")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(frame(spark, rows)).collect()}
    assert got == brute.substring(rows, 20)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(frame(spark, rows).select("doc_id", "text"), 3, 85).collect()}
    assert got == brute.near_groups(rows, 3, 85)
    want = brute.base_scores(rows)
    for r in lm_scoring.score(frame(spark, rows)).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and r.base_score == pytest.approx(want[r.doc_id][4])
    for r in quality_rules.judge(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.statistics(dict(rows)[r.doc_id])
    seen = [r.words for r in quality_classifier.looked_at(frame(spark, rows), np.sort(span_hashes(np.frombuffer(PAIRS[0][0].encode(), np.uint8), np.array([0]), np.array([1024])))).select("words").collect()]
    assert sum(len(w) > 0 for w in seen) == 3  # the three texts that hold the first word


def test_items_without_an_id_hit_and_are_not_named(spark):
    item = " ".join(f"i{k}" for k in range(12))
    docs = [(1, f"x {item} y"), (2, "x y"), (3, "short one here")]
    bench = spark.createDataFrame([(None, item), (None, "short one"), (7, "other")], "item_id long, text string")
    for block in (200_000, 4):
        old, decontamination.BLOCK_WORDS = decontamination.BLOCK_WORDS, block
        try:
            got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.report(frame(spark, docs), bench).collect()}
        finally:
            decontamination.BLOCK_WORDS = old
        assert got == {1: (14, 12, 0, True), 2: (2, 0, 0, False), 3: (3, 2, 0, True)}


def test_large_benchmarks_send_only_candidates_on(spark, monkeypatch):
    """Many blocks: documents without a window are neither written nor shuffled."""
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 300)
    rnd = random.Random(8)
    items = [(k, prose(rnd, rnd.randint(1, 30), 5000)) for k in range(60)]
    docs = [(k, prose(rnd, 50, 5000)) for k in range(200)] + [(200 + k, f"{prose(rnd, 9)} {items[3 * k][1]} {prose(rnd, 9)}") for k in range(15)] + [(None, None), (900, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    written = []
    real = decontamination.cut
    monkeypatch.setattr(decontamination, "cut", lambda df: written.append((df.columns, out := real(df))) or out)
    got = decontamination.report(frame(spark, docs), bench)
    want = brute.contaminated(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.collect()} == want
    some = [df.count() for columns, df in written if "_key" in columns and "text" in columns]
    assert len(some) == 1 and some[0] <= sum(v[1] > 0 for v in want.values()) + 20
    kept = decontamination.decontaminate(frame(spark, docs), bench, 10, 0.3)
    assert {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if v[1] <= 0.3 * v[0]}
    assert decontamination.decontaminate(empty(spark), bench).count() == 0


def test_index_opens_in_another_session(spark, tmp_path, corpus_rows):
    docs = sorted(corpus_rows)
    parts = [docs[k : k + 40] for k in range(0, len(docs), 40)]
    want = brute.substring(docs, 20)
    index = substring_dedup.FingerprintIndex(spark, path=f"file://{tmp_path}/index")
    for k, part in enumerate(parts):
        if k:  # nothing but the path is left of the first object
            index = substring_dedup.FingerprintIndex.open(spark.newSession() if k % 2 else spark, f"file://{tmp_path}/index")
        assert index.window == 20 and index.fan_in == substring_dedup.FAN_IN
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(frame(spark, part), index=index).collect()}
        assert got == {i: want[i] for i, _ in part}
    assert len([p for p in (tmp_path / "index").iterdir() if p.name.startswith("manifest") and not p.name.endswith(".crc")]) == 1
    index.clear()
    assert not substring_dedup.FingerprintIndex.open(spark, f"file://{tmp_path}/index").runs


@pytest.fixture(scope="module")
def corpus_rows():
    rnd = random.Random(17)
    passage = prose(rnd, 45)
    return [(k, f"{prose(rnd, rnd.randint(0, 60))} {passage if k % 4 == 0 else ''} {prose(rnd, 10)}") for k in range(120)]


def test_one_window_in_very_many_documents(spark, monkeypatch):
    """Its rows pass by sorted; the verifying task holds the first only."""
    monkeypatch.setattr(substring_dedup, "PIECE", 40)
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    monkeypatch.setattr(substring_dedup, "TEXT", 50)
    p = " ".join(f"p{k}" for k in range(22))
    docs = [(k, f"a{k} {p} b{k}") for k in range(300)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(frame(spark, docs)).collect()}
    assert got == brute.substring(docs, 20)


def test_near_duplicates_leave_rows_without_id_or_partner(spark):
    rnd = random.Random(5)
    base = prose(rnd, 60)
    rows = [(3, base), (2, base), (9, prose(rnd, 40)), (None, base), (None, base), (4, None), (4, "")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in minhash_dedup.keep_one(frame(spark, rows)).collect())
    assert got == sorted((i is None, i or 0, t or "") for i, t in rows if i != 3)


def by_rows(rows, k, percent):
    """(id, set size, least id reachable) of rows whose ids may repeat: rows are compared one by one, and those of one id belong together."""
    numbered = [(1000 * i + n, t) for n, (i, t) in enumerate(rows)]
    groups = brute.near_groups(numbered, k, percent)
    first = {}
    links = [(x, y) for x, (_, y) in groups.items()] + [(x, first.setdefault(x // 1000, x)) for x, _ in numbered if groups[x][0]]
    least = union_find(*zip(*links))
    return sorted((x // 1000, size, least[x] // 1000) for x, (size, _) in groups.items())


def test_near_duplicates_of_every_row_of_a_repeated_id(spark):
    """Each set of a doc_id keeps its links, whichever is the least."""
    rnd = random.Random(41)
    a, b, c = (prose(rnd, 120, 4000) for _ in range(3))
    rows = [(5, a), (5, b), (10, a + " more"), (11, b + " more"), (12, c), (12, c), (4, c + " more"), (20, c), (20, a), (30, prose(rnd, 50, 4000)), (30, ""), (31, None)]
    got = near_rows(spark, rows, 3, 85)
    assert got == by_rows(rows, 3, 85)
    assert {i: c for i, _, c in got} == {4: 4, 5: 4, 10: 4, 11: 4, 12: 4, 20: 4, 30: 30, 31: 31}
    many = [(rnd.randrange(40), " ".join([*base.split()[: rnd.randrange(60, 80)], *prose(rnd, rnd.randrange(9), 4000).split()])) for base in (prose(rnd, 80, 4000) for _ in range(8)) for _ in range(12)]
    assert near_rows(spark, many, 3, 85) == by_rows(many, 3, 85)


def near_rows(spark, rows, k, percent):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(frame(spark, rows).select("doc_id", "text"), k, percent).collect())


def test_mixture_of_rows_without_ids_meets_its_target(spark):
    """A source of null ids: each row draws by its own text."""
    rows = [(None, f"w{k} x") for k in range(3000)] + [(k, "a b") for k in range(3000)]
    df = spark.createDataFrame([(i, t, "null" if i is None else "some") for i, t in rows], "doc_id long, text string, source string")
    got = source_mixing.report(df).collect()
    for null in (True, False):
        mine = [r for r in got if (r.doc_id is None) == null]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.1)


def test_very_long_texts(spark):
    """A text of more than a megabyte in operators 2, 3, 4, 5 and 8."""
    rnd = random.Random(23)
    long = prose(rnd, 200_000, 50_000)
    item = " ".join(long.split()[150_000:150_020])
    docs = [(1, long), (2, long + " more"), (3, prose(rnd, 30))]
    bench = [(5, item)]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontamination.report(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == brute.contaminated(docs, bench)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame(spark, docs).select("doc_id", "text"), 3, 85).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    want = brute.base_scores(docs)
    for r in lm_scoring.score(frame(spark, docs)).collect():
        assert (r.n_tokens, r.n_known) == want[r.doc_id][1:3] and r.base_score == pytest.approx(want[r.doc_id][4])
    for r in quality_rules.judge(frame(spark, docs), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.statistics(dict(docs)[r.doc_id])
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(turns).first().loss_chars == len(long)
