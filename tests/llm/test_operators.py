import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from talweg.llm import _shared, chat_format, components, decontamination, lm_scoring, minhash_dedup, quality_classifier, quality_rules, source_mixing, substring_dedup, token_counts, url_filters
from talweg.llm._shared import BitFilter
from talweg.llm._text import SPACE, chunks

ODD = [None, "", " \n\t ", "one", "ONE", "é\u00a0ß İ \u2003x", "a\x0bb\x0cc\x1cd", "x" * 5000, "<s> \\ [INST] </s>"]


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Rows (doc_id, text): prose, exact and near copies, shared passages, odd texts."""
    rnd = random.Random(7)
    texts = [prose(rnd, rnd.randint(1, 120)) for _ in range(60)]
    passage = prose(rnd, 40)
    for k in range(20):
        base = texts[k].split()
        near = [w if rnd.random() > 0.03 else "zz" for w in base]
        texts.append(" ".join(near))
        texts.append(texts[k])
        texts.append(f"{prose(rnd, 15)} {passage} {prose(rnd, 15)}")
        texts.append("\n".join([prose(rnd, 6), "same line here", prose(rnd, 6), "same line here", "* * #"]))
    texts += ODD
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts))


def frame(spark, rows, parts=4):
    """A table with every column, and some that clash with names used inside."""
    full = [(i, t, "en", f"s{0 if i is None else i % 3}", None if t is None else len(t), 1, "k", 2, 3) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, h long, key string, n long, row long").repartition(parts)


def empty(spark):
    return frame(spark, [], 1).where("false")


# --- text kernels and shared parts ------------------------------------------------


def test_words_are_split_as_stated(spark, corpus):
    import pyarrow as pa

    raw = [None if t is None else t.encode() for _, t in corpus]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in corpus]), pa.array(raw, pa.binary())], ["id", "text"])
    got = [c.words(d) for c, _ in chunks([batch.slice(3), batch.slice(0, 3)], SPACE) for d in range(c.n)]
    assert got == [brute.words(t) for _, t in corpus[3:] + corpus[:3]]


def test_bit_filter_has_no_false_negatives(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    f = BitFilter.build(df, "h", 5000)
    h = np.array([r.h for r in df.collect()], np.int64).view(np.uint64)
    assert f.might_contain(h).all()
    assert f.might_contain(h + np.uint64(12345)).mean() < 0.05
    assert not BitFilter.build(df.where("false"), "h", 0).might_contain(h).any()


def test_components(spark):
    rnd = random.Random(1)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 50 + k) for k in range(1, 40)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    want = components.union_find([a for a, _ in links], [b for _, b in links])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()}
    assert got == {n: r for n, r in want.items() if n in got} and {n for n in want if want[n] != n} <= set(got)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_by_rounds(spark, monkeypatch):
    """Star rounds alone, and rounds that end in one task, give what union-find gives."""
    rnd = random.Random(3)
    links = [(k, k + 1) for k in range(0, 20)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(80)]
    want = components.union_find([a for a, _ in links], [b for _, b in links])
    df = spark.createDataFrame(links, "u long, v long").repartition(3)
    for small in (0, 60):
        monkeypatch.setattr(components, "SMALL", small)
        got = {r.node: r.component for r in components.components(df).collect()}
        assert got == {n: r for n, r in want.items() if n in got} and {n for n in want if want[n] != n} <= set(got)


# --- 1 ----------------------------------------------------------------------------


def test_token_counts(spark, corpus):
    from collections import Counter
    from pathlib import Path

    ranks = Path(token_counts.VOCABULARY).read_bytes()
    n = token_counts.encoded_lengths([t for _, t in corpus], ranks)
    hist = token_counts.length_histogram(frame(spark, corpus))
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == Counter(n)
    sums = token_counts.suffix_sums(hist, block=16).cache()
    for r in sums.collect():
        assert r.docs_ge == sum(x >= r.n_tokens for x in n) and r.tokens_ge == sum(x for x in n if x >= r.n_tokens)
        assert r.docs_le == sum(x <= r.n_tokens for x in n) and r.truncated_total == sum(min(x, r.n_tokens) for x in n)
        assert (r.total_docs, r.total_tokens) == (len(n), sum(n)) and r.quantile == pytest.approx(r.docs_le / len(n))
    for r in token_counts.at_limits(sums, [0, 7, 100, 10**6]).collect():
        assert r.docs_over == sum(x > r.context for x in n) and r.docs_fitting == len(n) - r.docs_over and r.truncated_total == sum(min(x, r.context) for x in n)
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == min(x for x in n if sum(y <= x for y in n) >= r.share * len(n))
    assert token_counts.suffix_sums(token_counts.length_histogram(empty(spark))).count() == 0
    with pytest.raises(FileNotFoundError, match="vocabulary"):
        token_counts.length_histogram(frame(spark, corpus), vocabulary="/nowhere.tiktoken")


def test_long_texts_encode_in_parts_like_the_whole(corpus, monkeypatch):
    from pathlib import Path

    ranks = Path(token_counts.VOCABULARY).read_bytes()
    rnd = random.Random(31)
    marks = ["  ", " ", "\n", " 12 ", "'s ", "é ", "² ", "_", " \u00a0", "don't "]
    texts = [t for _, t in corpus] + ["".join(rnd.choice(marks) + prose(rnd, 2) + " ab cd" for _ in range(60)), "x" * 3000]
    want = token_counts.encoded_lengths(texts, ranks)
    monkeypatch.setattr(token_counts, "PART", 7)
    assert token_counts.encoded_lengths(texts, ranks) == want and len(list(token_counts._parts(texts[-2]))) > 20


# --- 2 ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def items(corpus):
    rnd = random.Random(3)
    good = [t for _, t in corpus if t and len(t.split()) > 30]
    cut = lambda t, n: " ".join(t.split()[3 : 3 + n])
    return [(1, cut(good[0], 25)), (2, cut(good[5], 12).upper() + "!"), (3, cut(good[9], 4)), (4, "same line here"), (5, prose(rnd, 30)), (6, ""), (7, None), (10, cut(good[0], 25)), (11, cut(good[2], 10) + "," + cut(good[2], 10))]


@pytest.mark.parametrize("block", [200_000, 40])
def test_decontamination_report(spark, corpus, items, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontamination.report(frame(spark, corpus), bench).collect()}
    want = brute.contaminated(corpus, items)
    assert got == want and sum(v[1] > 0 for v in want.values()) > 5


def test_automaton_on_tiny_alphabet():
    rnd = random.Random(5)
    for k in (1, 2, 3, 5):
        items = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9)))) for i in range(6)]
        docs = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 25)))) for i in range(40)]
        auto = decontamination.Automaton([(i, t.encode().split()) for i, t in items], k)
        want = brute.contaminated(docs, items, k)
        for i, t in docs:
            spans, found = auto.hits(t.encode().split())
            assert (sum(b - a for a, b in spans), len(found)) == want[i][1:3]


def test_decontaminate_cuts_and_drops(spark):
    item = " ".join(f"q{k}" for k in range(12))
    long = " ".join(f"c{k}" for k in range(40))
    docs = [(1, f"{long} {item}. {long}"), (2, item), (3, long), (4, None), (5, ""), (None, f"{long} {item}"), (1, f"{long} {item}. {long}")]
    df = frame(spark, docs)
    out = decontamination.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.schema == df.schema
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted([(1, f"{long} . {long}", 2 * len(long) + 3)] * 2 + [(3, long, len(long)), (4, None, None), (5, "", 0), (None, long, len(long))], key=str)
    assert decontamination.decontaminate(empty(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [200_000, 40, 15])
def test_decontaminate_is_the_same_by_blocks(spark, block, monkeypatch):
    """Coverage is judged once for all blocks, overlapping items are cut whole, and no passage arises by cutting."""
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    run = lambda k, n: [f"w{i}" for i in range(k, k + n)]
    rare = lambda k, n: [f"x{i}" for i in range(k, k + n)]
    items = [run(k, 14) for k in range(0, 200, 7)] + [[*rare(5 * k, 5), *rare(1000 + 5 * k, 5)] for k in range(12)]
    docs = [
        [*run(0, 14), *rare(500, 8), *run(70, 14), *rare(520, 10)],  # two items that cover 28 of 46 words
        [*rare(500, 60), *run(0, 60), *rare(600, 60)],  # items that overlap
        *([*rare(5 * k, 5), *run(7 * j, 14), *rare(1000 + 5 * k, 5), *rare(700, 40)] for k in range(12) for j in range(3)),  # words that become neighbours
        rare(300, 30),
        run(0, 9),
    ]
    df = frame(spark, [(i, " ".join(w)) for i, w in enumerate(docs)] + [(1, " ".join(docs[1])), (None, None)])
    out = decontamination.decontaminate(df, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    assert out.schema == df.schema
    windows = {tuple(w[k : k + 10]) for w in items for k in range(len(w) - 9)}
    want = [(None, None)]
    for i, w in [*enumerate(docs), (1, docs[1])]:
        hit = {j for k in range(len(w) - 9) if tuple(w[k : k + 10]) in windows for j in range(k, k + 10)}
        if len(hit) <= 0.5 * len(w):
            want.append((i, " ".join(x for j, x in enumerate(w) if j not in hit)))
    assert 0 not in dict(want) and 1 in dict(want)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


# --- 3 ----------------------------------------------------------------------------


def test_superminhash_estimates_similarity():
    h = minhash_dedup.mix(np.arange(1, 3001, dtype=np.uint64))
    errors = []
    for k in range(20):
        part = h[k * 140 : k * 140 + 140]
        sig = minhash_dedup.signatures(np.concatenate([part[:100], part[20:120]]), np.repeat([0, 1], 100), 2, 200)
        errors.append((sig[0] == sig[1]).mean() - 80 / 120)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.05
    one = minhash_dedup.signatures(h[:5], np.zeros(5, int), 1, 16)
    assert len(set(one[0].tolist())) == 16  # five elements fill sixteen places, each step once
    doc = np.sort(np.random.default_rng(0).integers(0, 6, 3000))
    whole = minhash_dedup.signatures(h, doc, 7)
    assert all(np.array_equal(whole, minhash_dedup.signatures(h, doc, 7, most=n)) for n in (1, 100, 700, 2999))


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80), (1, 60)])
def test_near_duplicates(spark, corpus, shingle, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(frame(spark, corpus), shingle, percent).collect()}
    want = brute.near_groups(corpus, shingle, percent)
    assert got == want and sum(v[1] != i for i, v in want.items()) > 15


def test_stated_loss_is_that_of_the_bands():
    rows = minhash_dedup.PLACES // minhash_dedup.BANDS
    for s, stated in ((0.85, "8e-6 at 0.85"), (0.8, "3.6e-4 at 0.8")):
        assert stated in minhash_dedup.__doc__
        assert (1 - s**rows) ** minhash_dedup.BANDS == pytest.approx(float(stated.split()[0]), rel=0.02)


def test_chains_of_near_copies_join(spark):
    """Neighbours are alike, ends are not: everything found must hang together."""
    w = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(w[3 * k : 3 * k + 100])) for k in range(40)]
    want = brute.near_groups(docs, 2, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(frame(spark, docs), 2, 85).collect()}
    assert got == want and len({v[1] for v in want.values()}) == 1


def test_near_duplicates_edges(spark):
    t = "a b c d e f g h"
    rows = [(5, t), (3, t), (3, t), (None, t), (9, None), (8, "")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(frame(spark, rows), 3, 85).collect()), key=str)
    assert got == sorted([(5, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (9, 9, True), (8, 8, True)], key=str)
    kept = minhash_dedup.keep_one(frame(spark, rows))
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["3", "3", "8", "9", "None"] and kept.columns == frame(spark, rows).columns
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


# --- 4 ----------------------------------------------------------------------------


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h string").repartition(3)


def test_chat_round_trip(spark):
    rnd = random.Random(2)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "[ROLE] x [/ROLE]", " ", "\n", "é", "[", "<", "ok", ""]
    rows, want = [], {}
    for c in range(30):
        turns = [(rnd.choice(["user", "assistant", "system", "tool]", None]), rnd.choice([None, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))])) for _ in range(rnd.randint(1, 90 if c == 0 else 6))]
        rows += [(c, k, r, t, "x") for k, (r, t) in enumerate(turns)]
        flat = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        full = chat_format.inst_template([(r or "", t or "") for r, t in turns])
        assert [(r, t) for r, t, _, _ in chat_format.parse(full)] == [(r or "", t or "") for r, t in turns]
        want[c] = (len(turns), brute.sha(flat), len(loss), brute.sha(loss), len(full), 0)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.digests(conversations(spark, rows)).collect()}
    assert got == want
    joined = {}
    for r in chat_format.formatted(conversations(spark, rows)).orderBy("conv_id", "position").collect():
        joined[r.conv_id] = joined.get(r.conv_id, "") + r.span
    assert joined == {c: chat_format.inst_template([(r or "", t or "") for i, _, r, t, _ in rows if i == c]) for c in want}
    assert chat_format.digests(conversations(spark, rows).where("false")).count() == 0


def test_templates_that_rewrite_history_are_found(spark):
    def forgetful(turns):
        """Keeps thoughts in the last turn only."""
        return "".join(f"<{r}>{t if k == len(turns) - 1 else t.replace('(hm)', '')}" for k, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "(hm) yes", ""), (1, 2, "user", "so", ""), (2, 0, "user", "a", ""), (2, 1, "assistant", "b", "")]
    got = [(r.conv_id, r.position, r.rewritten) for r in chat_format.turn_spans(conversations(spark, rows), forgetful).orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, False), (1, 1, False), (1, 2, True), (2, 0, False), (2, 1, False)]
    spans = {(r.conv_id, r.position): r.span[r.text_start : r.text_end] for r in chat_format.turn_spans(conversations(spark, rows)).collect()}
    assert spans[1, 1] == "(hm) yes" and spans[2, 0] == "a"


def test_templates_are_judged_on_whole_prefixes_of_long_conversations(spark):
    """What changes or reads the far past is found after any number of turns."""
    n = 3 * chat_format.WHOLE
    turns = [("user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(n)]
    df = conversations(spark, [(1, k, r, t, "") for k, (r, t) in enumerate(turns)])

    def last_twenty(turns):
        return "".join(f"<{r}>{t}" for r, t in turns[-20:])

    def edits_first(turns):
        return "".join(f"<{r}>{t}{'!' if k == 0 and len(turns) > 50 else ''}" for k, (r, t) in enumerate(turns))

    def numbered(turns):
        return "".join(f"<{k} {turns[0][1]} {r}>{t}" for k, (r, t) in enumerate(turns))

    flags = lambda template: [r.rewritten for r in chat_format.turn_spans(df, template).orderBy("position").collect()]
    assert flags(last_twenty) == [k >= 20 for k in range(n)]
    assert flags(edits_first) == [k == 50 for k in range(n)]
    assert not any(flags(numbered)) and not any(flags(chat_format.inst_template))
    rows = chat_format.turn_spans(df, numbered).orderBy("position").collect()
    assert "".join(r.span for r in rows) == numbered(turns)
    assert [r.span[r.text_start : r.text_end] for r in rows[1:]] == [t for _, t in turns[1:]]


@pytest.mark.parametrize("n", [40, 200])
def test_templates_that_check_roles_or_forget(n):
    """Spans of every prefix against rendering all prefixes, for templates that raise unless roles alternate, number turns, or forget old ones."""
    turns = [(("user", "assistant")[k % 2], f"text {k} \\ </s>") for k in range(n)]

    def strict(ts):
        if any(r != ("user", "assistant")[k % 2] for k, (r, _) in enumerate(ts)):
            raise ValueError("roles must alternate, the user first")
        return "".join(f"<{r}>{t}</{r}>" for r, t in ts)

    def forgets(ts):
        strict(ts)
        return "".join(f"[{k}:{t}]" for k, (_, t) in list(enumerate(ts))[-20:])

    for render, rewrites in ((strict, lambda k: False), (forgets, lambda k: k >= 20)):
        state, out = chat_format.Incremental(render), ""
        for k, turn in enumerate(turns):
            span, a, b, rewritten = state.add(turn)
            whole = render(turns[: k + 1])
            assert rewritten == rewrites(k) == (not whole.startswith(out)) and whole.endswith(span)
            if not rewritten:
                assert out + span == whole and span[a:b] == turn[1]
            out = whole


# --- 5 ----------------------------------------------------------------------------


@pytest.mark.parametrize("limits", [{}, {"max_bytes": 1 << 14}, {"max_words": 5}])
def test_lm_scoring(spark, corpus, limits):
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, corpus), **limits).collect()}
    for i, (held, n, known, total, base) in brute.base_scores(corpus).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score < 0 and np.isfinite(r.score)
    assert len(got) == len(corpus)
    if not limits:  # seen text is likelier than word counts alone say
        ours = sum(got[i].score for i, _ in corpus if not got[i].held_out)
        assert ours > sum(got[i].base_score for i, _ in corpus if not got[i].held_out)


@pytest.mark.parametrize("most_frequent", [1, 200, 1 << 20])
def test_lm_pairs_by_shuffle(spark, corpus, most_frequent):
    """The same scores as with a broadcast filter, whether none, some or all pairs are frequent, but for the filter's chance hits."""
    docs = frame(spark, corpus)
    one = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    other = {r.doc_id: r for r in lm_scoring.score(docs, max_bytes=1 << 13, most_frequent=most_frequent).collect()}
    assert one.keys() == other.keys()
    for i, r in one.items():
        assert r[:6] == other[i][:6] and other[i].score == pytest.approx(r.score, rel=0.02, abs=0.5)
    if most_frequent == 1 << 20:
        return
    exact = sum(abs(r.score - other[i].score) < 1e-6 for i, r in one.items())
    assert exact >= 0.9 * len(one)  # the pieces hold the same bits


@pytest.mark.parametrize("entries", [1_000, 10**8, 10**9, 10**10])
def test_filter_has_its_bits_at_every_size(entries):
    """Its rate of chance hits stays that of BITS bits for each entry: no cap on the whole."""
    pieces = lm_scoring._pieces(entries)
    bits = lm_scoring._piece_bytes(entries, pieces) * 8 * pieces / entries
    assert (1 - np.exp(-lm_scoring.PROBES / bits)) ** lm_scoring.PROBES < 0.03


@pytest.mark.parametrize("limits", [{}, {"max_words": 5}, {"max_words": 5, "most_frequent": 1}])
def test_lm_filters_beyond_their_limit(spark, corpus, limits, monkeypatch):
    """The scores stay those of exact counts' levels where words and pairs all pass max_bytes, and of unseen pairs few count as seen."""
    monkeypatch.setattr(lm_scoring, "MAX_BYTES", 256)
    if lm_scoring._piece_bytes.__defaults__:
        monkeypatch.setattr(lm_scoring._piece_bytes, "__defaults__", (256,))
    text = {i: brute.low_words(t) for i, t in corpus}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in text}
    ones, twos = {}, {}
    for i, words in text.items():
        if not held[i]:
            for v, w in zip([None, *words], [*words, None]):
                ones[w], twos[v, w] = ones.get(w, 0) + 1, twos.get((v, w), 0) + 1
    near = lambda n: lm_scoring.LEVEL_COUNT[int(lm_scoring.level(np.array([n]))[0])]
    total, kinds = sum(ones.values()), len(ones)
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, corpus), max_bytes=256, **limits).collect()}
    base = brute.base_scores(corpus)
    off = tokens = 0
    for i, words in text.items():
        want = 0.0
        for v, w in zip([None, *words], [*words, None]):
            before, alone = near(ones.get(v, 0)), (near(ones.get(w, 0)) + 1) / (total + kinds + 1)
            share = min(1.0, near(twos.get((v, w), 0)) / before) if before else 0.0
            want += np.log10(lm_scoring.PAIR * share + (1 - lm_scoring.PAIR if before else 1.0) * alone)
        assert got[i].base_score == pytest.approx(base[i][4], abs=1e-9) and got[i].n_known == base[i][2]
        off, tokens = off + abs(got[i].score - want), tokens + len(words) + 1
    assert off / tokens < 0.04


def test_lm_edges(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(None, "a b"), (1, None), (1, None), (2, "a b")]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens) for r in lm_scoring.score(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, False, 3), (1, held(1), 1), (1, held(1), 1), (2, held(2), 3)], key=str)
    assert lm_scoring.score(empty(spark)).count() == 0
    nothing = lm_scoring.score(frame(spark, rows), held_out=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0 for r in nothing)


def test_log_frequency_filter(spark):
    rows = [(int(k), int(n)) for k, n in zip(range(1, 3001), np.random.default_rng(0).geometric(0.1, 3000))]
    halves = [(h, n) for k, count in rows for h in [int(lm_scoring.mix(np.array([k], np.uint64)).view(np.int64)[0])] for n in ([count] if count == 1 else [1, count - 1])]
    df = spark.createDataFrame(halves, "h long, n long").repartition(3)

    def pack(batches):
        for b in batches:
            yield lm_scoring._packed(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), 16)

    packed = df.mapInArrow(pack, "piece int, h binary, n binary")
    f = lm_scoring.LogFrequencyFilter.build(packed, 16, lm_scoring._piece_bytes(int(lm_scoring.level(np.array([n for _, n in rows])).sum()), 16))
    levels = f.levels(lm_scoring.mix(np.arange(1, 3001, dtype=np.uint64)))
    true = lm_scoring.level(np.array([n for _, n in rows]))
    assert (levels >= true).all() and (levels > true).mean() < 0.1  # one-sided
    assert (f.levels(lm_scoring.mix(np.arange(9001, 12001, dtype=np.uint64))) > 0).mean() < 0.1


# --- 6 ----------------------------------------------------------------------------


def test_url_filters(spark):
    urls = {
        1: "http://NET/x", 2: "https://a.example.net/en/1?x", 3: "https://example.net/enx", 4: "https://example.net", 5: "http://b.example.com/de/7#t", 6: "http://c.org/fr/", 7: "http://corg/fr/", 8: None, 9: "no scheme", 10: "",
        11: "http://my.example.org/casino/1", 12: "http://casinos.org/x", 13: "ftp://x://y.net/", 14: "http://u.example.org/torrent/a/download", 15: "http://example.com/DE/", 16: "http://badnet/", 17: "://",
    }
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(list(urls.items()), "page_id long, url string")).collect()}
    assert got[1] == ("net", "/x", "net/", "block") and got[2] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[3] == ("example.net", "/enx", "net/", "block")
    assert got[4] == ("example.net", "", None, "allow") and got[5][2:] == ("example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow") and got[7][2:] == (None, "allow")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow") and got[17][:2] == ("", "")
    assert got[11][2:] == (None, "block") and got[12][2:] == (None, "allow") and got[13][0] == "x:" and got[14][3] == "block" and got[15][2] is None and got[16][2] is None
    # fetching by token finds what running every rule finds
    rules = url_filters.default_rules()
    index = url_filters.RuleIndex(rules, {"example": 9, "net": 1})
    every = url_filters.RuleIndex([url_filters.Rule(r.name, r.verdict, r.pattern, (), r.weight, r.is_host) for r in rules], {})
    for u in urls.values():
        parts = url_filters.split_url(u)
        assert index.judge(*parts)[:2] == every.judge(*parts)[:2] and index.judge(*parts)[2] <= every.judge(*parts)[2]
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_rules_of_a_table(spark):
    """Thousands of rules, held against running every rule; words end at letters beyond ASCII as in the SQL."""
    import duckdb

    rnd = random.Random(8)
    part = lambda: f"{rnd.choice('abcdefgh')}{rnd.randrange(40)}"
    rows = [(rnd.choice(["block", "allow"]), f"{part()}.{part()}/" + rnd.choice(["", part()]), None, None) for _ in range(2500)]
    rows += [("block", f"p{k}", rf"\b{part()}\b.*[-/]{(q := part())}\b", q) for k in range(1500)] + [("block", "no literal", "zz+top", None), rows[0]]
    rules = url_filters.rules_from(spark.createDataFrame(rows, "verdict string, rule string, pattern string, literals string"))
    assert len(rules) == len(set(rows))
    urls = {k: f"http://{part()}.{part()}.{part()}/{part()}-{part()}/{part()}?{rnd.choice(['', 'zzztop', 'q=é'])}" for k in range(300)}
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(list(urls.items()), "page_id long, url string"), rules).collect()}
    every = url_filters.RuleIndex([url_filters.Rule(r.name, r.verdict, r.pattern, (), r.weight, r.is_host) for r in rules], {})
    for k, u in urls.items():
        rule, verdict, run = every.judge(*url_filters.split_url(u))
        assert (got[k].rule, got[k].verdict) == (rule, verdict or "allow") and got[k].n_run < 0.05 * run
    assert sum(r.verdict == "block" for r in got.values()) > 20
    with pytest.raises(ValueError):
        url_filters.rules_from(spark.createDataFrame([("maybe", "a/", None, None)], "verdict string, rule string, pattern string, literals string"))
    odd = spark.createDataFrame([(1, "http://casinoé.org/"), (2, "http://a.org/CASİNO"), (3, "http://a.org/Kasino/poKer"), (4, "http://a.org/poKer"), (5, None), (6, "http://ÀB.ORG/fr/" + "x" * 100000)], "page_id long, url string")
    mine = {tuple(r) for r in url_filters.judge(odd).drop("n_run").collect()}
    pages = odd.toPandas()  # noqa: F841
    assert mine == set(duckdb.sql("WITH pages AS (SELECT * FROM pages) " + url_filters.ORACLE.strip().replace("WITH u AS", ", u AS", 1)).fetchall())


# --- 7 ----------------------------------------------------------------------------


def test_mixing(spark, corpus):
    rnd = random.Random(11)
    rows = [(i, t, None if i % 17 == 0 else rnd.choice(["a", "B", "é", "zz", "tiny"] if i != 5 else ["tiny"])) for i, t in corpus] + [(None, "q r s", "a"), (3, "again", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mixing.report(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.level_targets(sizes)
    of = {(i, len(brute.words(t))): s for i, t, s in rows}
    taken = {}
    for r in got:
        s = of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values())) and all(abs(taken[s] - want[s]) < 0.5 * want[s] for s in sizes if sizes[s] > 500)
    again = source_mixing.emit(df.repartition(7)).groupBy("doc_id").count().collect()
    copies = {r.doc_id: r["count"] for r in again}
    assert all(copies.get(r.doc_id, 0) * r.size == r.taken for r in got if r.doc_id not in (3, None) and r.size)
    none = spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in source_mixing.report(none).collect()] == [(0, 0.0, 0)]
    assert source_mixing.report(df.where("false")).count() == 0


@pytest.mark.parametrize("broadcast", [0, 100])
def test_mixing_many_sources_without_and_with_a_broadcast(spark, broadcast, monkeypatch):
    monkeypatch.setattr(source_mixing, "BROADCAST_SOURCES", broadcast)
    rnd = random.Random(12)
    rows = [(i, prose(rnd, 20), None if i % 9 == 0 else f"s{i % 9}", i, "kept", 5) for i in range(1800)] + [(5000, None, "s1", 5000, "kept", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy long, _mix_rate string, Copy_ long").repartition(5)
    out = source_mixing.emit(df)
    assert out.columns == [*df.columns, "copy__"] and out.where("_mix_rate <> 'kept' or Copy_ <> 5").isEmpty() and all(r["copy"] == r.doc_id for r in out.collect())
    want = brute.level_targets({f"s{k}" if k else None: 4000 for k in range(9)})
    words = {r.source: r.n * 20 for r in out.groupBy("source").agg(F.count("text").alias("n")).collect()}
    assert all(abs(words[s] - want[s]) < 0.25 * want[s] for s in want), (words, want)
    got = {r.doc_id: r for r in source_mixing.report(df).collect()}
    n = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.max("copy__").alias("n")).collect()}
    assert all(r.taken == r.size * n.get(i, 0) and r.target == pytest.approx(want[rows[i][2]]) for i, r in got.items() if i < 5000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning" in plan) == (broadcast == 0)


# --- 8 ----------------------------------------------------------------------------


def test_quality_statistics(spark, corpus):
    rows = corpus + [(900, "a b c a b c\n\na b c\n \n \nx | y\r\nx | y\r\n"), (901, "q\n" * 60), (902, "\n\n"), (None, "a")]
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules.judge(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    for i, t in rows:
        want = brute.statistics(t)
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i][:7] == (*want, failed, not failed) and got[i][7] is None
    assert quality_rules.judge(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def junk_corpus(n=600):
    rnd = random.Random(13)
    docs, labels = [], []
    for i in range(n):
        text, bad = prose(rnd, rnd.randint(60, 120), 3000), rnd.random() < 0.3
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 2 else text.replace(" ", " | ")
        toxic = not bad and rnd.random() < 0.2
        if toxic:
            text += " scum " + prose(rnd, 5)
        docs.append((i, text))
        if i % 4:
            labels.append((i, int(not bad), int(toxic)))
    truth = {i: (q, t) for i, (q, t) in ((i, (int("!!" not in x and " | " not in x), int("scum" in x))) for i, x in docs)}
    return docs, labels, truth


def test_trees_tell_junk_and_keep_their_direction(spark):
    docs, labels, truth = junk_corpus()
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(df, lab).collect()}
    held = [i for i in truth if i % 4 == 0]
    assert np.mean([got[i].kept == bool(truth[i][0]) for i in held]) > 0.95
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=800) > 0).astype(float)
    signs = [1, -1, 0]
    trees = quality_rules.fit(x, y, signs)
    probe = rng.normal(size=(200, 3))
    for j, s in ((0, 1), (1, -1)):
        up = probe.copy()
        up[:, j] += rng.exponential(size=200)
        assert (s * (trees.score(up) - trees.score(probe)) >= -1e-9).all()
    assert ((trees.score(x) > 0) == (y > 0)).mean() > 0.75


# --- 9 ----------------------------------------------------------------------------


@pytest.mark.parametrize("window,run,hot,fan,batches", [(20, 10, 4, 2, 3), (4, 2, 1, 2, 3), (3, 3, 256, 4, 1), (5, 1, 2, 2, 4)])
def test_substring_dedup(spark, corpus, window, run, hot, fan, batches, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BATCHES", batches)
    monkeypatch.setattr(substring_dedup, "FAN_IN", fan)
    if batches == 3:  # repeated anchors and documents by joins in place of bit filters; long texts in parts
        monkeypatch.setattr(substring_dedup, "MOST_FILTERED", 0)
        monkeypatch.setattr(_shared, "MOST_FILTERED", 0)
        monkeypatch.setattr(substring_dedup, "LONG", 40)
    rnd = random.Random(window)
    docs = corpus if window == 20 else [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 30)))) for i in range(150)] + [(500, None), (501, ""), (502, "a b " * 40)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(frame(spark, docs, 6), window, run).collect()}
    want = brute.substring(docs, window)
    assert got == want and sum(v[1] for v in want.values()) > 100


@pytest.mark.parametrize("fan", [2, 9])
def test_batches_on_one_index_are_like_all_at_once(spark, corpus, fan):
    docs = sorted(corpus)
    p = " ".join(f"p{k}" for k in range(30))
    docs += [(1000, f"a {p} b"), (1001, "q " * 50), (2000, p), (2001, f"x y {p}"), (2002, "q " * 30)]
    want = brute.substring(docs, 20)
    index = substring_dedup.FingerprintIndex(spark, fan_in=fan)
    parts = [docs[k : k + 50] for k in range(0, len(docs), 50)]
    assert len(parts) >= 3
    for part in parts:
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(frame(spark, part), index=index).collect()}
        assert got == {i: want[i] for i, _ in part}
    assert (index.compactions > 0) == (fan < len(parts)) and len(index.runs) <= fan + 1
    if fan == 2:  # sorted runs that count each anchor once
        for r in index.runs:
            rows = r.counts.groupBy("h").count().where("count > 1")
            assert rows.isEmpty() and r.rows.where("h is not null").agg(F.countDistinct("h")).first()[0] == r.counts.count()
    # the same documents again: each place has been seen, and is no repeat of itself
    again = {r.doc_id: r.n_removed for r in substring_dedup.report(frame(spark, parts[-1]), index=index).collect()}
    assert again == {i: want[i][1] for i, _ in parts[-1]}
    # copies under new ids are repeats of history as a whole
    copies = {r.doc_id: r.n_removed for r in substring_dedup.report(frame(spark, [(i + 5000, t) for i, t in parts[-1]]), index=index).collect()}
    assert all(copies[i + 5000] == (want[i][0] if want[i][0] >= 20 else 0) for i, _ in parts[-1])
    index.clear()


def test_text_parts_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(substring_dedup, "LONG", 13)
    rnd = random.Random(2)
    for text in ["", " ", "x" * 90, " a  b\tcc " * 9, prose(rnd, 60), "word " + "y" * 50 + " end"]:
        words, seen = text.encode().split(), {}
        for first, part in substring_dedup.text_parts(text.encode(), 2):
            got = part.split()
            for k in range(len(got) - 2):
                assert first + k not in seen
                seen[first + k] = got[k : k + 3]
        assert seen == {k: words[k : k + 3] for k in range(len(words) - 2)}


def test_documents_without_an_id_are_told_apart(spark):
    p = " ".join(f"p{k}" for k in range(25))
    rows = [(1, p), (None, f"one {p}"), (None, f"two {p}"), (None, None), (None, ""), (None, " ".join(f"z{k}" for k in range(25)))]
    got = sorted((r.n_words, r.n_removed) for r in substring_dedup.report(frame(spark, rows)).collect())
    assert got == [(0, 0), (0, 0), (25, 0), (25, 0), (26, 25), (26, 25)]


def test_remove_duplicates(spark):
    p = " ".join(f"p{k}" for k in range(30))
    rows = [(1, f"head {p} tail"), (2, f"x\n{p}  y z"), (3, p), (4, None), (5, "short one"), (None, f"last {p}"), (3, p)]
    df = frame(spark, rows)
    out = substring_dedup.remove_duplicates(df, 20)
    assert out.schema == df.schema
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted([(1, rows[0][1], len(rows[0][1])), (2, "x y z", 5), (4, None, None), (5, "short one", 9), (None, "last", 4)], key=str)
    assert substring_dedup.report(empty(spark)).count() == 0


# --- 10 ---------------------------------------------------------------------------


def test_flat_trees_are_those_of_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=600) > 0.3).astype(float)
    t = quality_rules.fit(x, y, [1, 0, 0], trees=12)

    def walk(row):
        total = t.base
        for at in t.roots:
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.value[at]
        return total

    assert np.allclose(t.score(x), [walk(r) for r in x]) and np.mean((t.score(x) > 0) == (y > 0)) > 0.85


def test_quality_classifier(spark):
    docs, labels, truth = junk_corpus(900)
    docs = docs + [(5000, None), (5001, " "), (None, next(t for i, t in docs if truth[i] == (1, 0)))]
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.score(df, lab).collect()}
    held = [i for i in truth if i % 4 == 0]
    good = {i: truth[i] == (1, 0) for i in held}
    assert np.mean([got[i].kept for i in held if good[i]]) > 0.97
    assert np.mean([not got[i].kept for i in held if truth[i][0] == 0]) > 0.95
    assert np.mean([not got[i].kept for i in held if truth[i][1]]) > 0.7
    assert not got[5000].kept and got[5000].score == 0.0 and not got[5001].kept and got[None].kept
    kept = quality_classifier.keep_good(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.kept or i is None}
    none = quality_classifier.score(df, lab.where("false")).where("doc_id >= 5000 or doc_id = 0").collect()
    assert {(r.doc_id, r.score, r.kept) for r in none} == {(0, None, True), (5000, None, False), (5001, None, False)}
    assert quality_classifier.score(empty(spark), lab).count() == 0


def test_rows_are_kept_by_their_own_verdict(spark):
    """Neither a missing nor a shared doc_id decides."""
    docs, labels, truth = junk_corpus(900)
    good, junk = (next(t for i, t in docs if truth[i] == kind and i % 4 == 0) for kind in ((1, 0), (0, 0)))
    docs = docs + [(None, junk), (None, None), (None, good), (7000, good), (7000, junk), (7000, good)]
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality_classifier.keep_good(df, lab)
    assert kept.schema == df.schema
    verdicts = sorted(((r.doc_id, r.kept) for r in quality_classifier.score(df, lab).collect() if r.kept), key=str)
    rows = kept.collect()
    assert sorted(((r.doc_id, True) for r in rows), key=str) == verdicts
    assert [r.text for r in rows if r.doc_id is None] == [good] and [r.text for r in rows if r.doc_id == 7000] == [good, good]


def test_items_without_an_id_are_cut(spark):
    item, long = " ".join(f"q{k}" for k in range(12)), " ".join(f"c{k}" for k in range(40))
    out = decontamination.decontaminate(frame(spark, [(1, f"{long} {item}")]), spark.createDataFrame([(None, item)], "item_id long, text string"))
    assert [r.text for r in out.collect()] == [long]


def plain_looks(rows, looks):
    """Features of both views of (text, source, lang, n_chars), one document at a time."""
    place = {int(h): k for k, h in enumerate(looks.words)}
    out = []
    for text, *meta in rows:
        chunk = next(chunks([pa_batch(text)], quality_classifier.ALNUM, lower=True))[0]
        words = {place[int(h)] for h in chunk.word_hash if int(h) in place}
        n, chars, symbols, dup, repeat = brute.statistics(text)
        raw = text or ""
        w, t, lines = max(1, n), max(1, len(raw)), max(1, sum(bool(line.split()) for line in raw.encode().split(b"\n")))
        share = lambda kind: sum(c in kind for c in raw) / t
        stats = [np.log1p(n), chars / w, symbols / t, share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("!?"), dup / lines, repeat / w, len(set(raw.encode().split())) / w, w / lines]
        base, bins = len(looks.words), []
        for e, x in zip(looks.edges, stats):
            bins.append(base + sum(x > b for b in e))
            base += len(e) + 1
        out.append((sorted(words) + bins, stats, quality_classifier.metadata_features(*([x] for x in meta))[0].tolist()))
    return out


def pa_batch(text):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([0]), pa.array([None if text is None else text.encode()], pa.binary())], ["id", "text"])


def plain_logit(view, features, stats):
    m, told = view.model, sum(view.told[f] for f in features)
    dense = [min(8, max(-8, (x - a) / b)) * w for x, a, b, w in zip([*stats, told], m.mean, m.scale, m.dense)]
    return sum(m.weight[f] for f in features) + sum(dense) + m.bias


def test_classifier_is_that_of_plain_python(spark):
    """The sums that views tell each other, and all scores, against one document at a time."""
    docs, labels, _ = junk_corpus(400)
    docs += [(900, None), (901, " "), (None, "w1 w2 scum"), (None, "W3!! W4!!")]
    df, lab = frame(spark, docs, 7), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, every = quality_classifier.train(df, lab)
    rows = {(r.doc_id, r.text): (r.text, r.source, r.lang, r.n_chars) for r in df.collect()}
    keys, seen = list(rows), plain_looks(rows.values(), model.looks)
    known = {i for i, _, _ in labels}
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    want = {"text": np.zeros((len(model.views["text"].told) + 1, 2)), "meta": np.zeros((quality_classifier.META + 1, 2))}
    scores = {}
    for key, (features, stats, meta) in zip(keys, seen):
        a, b = plain_logit(model.views["text"], features, stats), plain_logit(model.views["meta"], meta, [])
        p = sigmoid(np.clip(a, -12, 12) * model.mix[0] + np.clip(b, -12, 12) * model.mix[1] + model.mix[2])
        scores[key] = (p if (key[1] or "").split() else 0.0, sigmoid(a), sigmoid(b))
        if key[0] in known:
            continue
        for z, other, its in ((a, "meta", meta), (b, "text", features)):
            for k, sure in enumerate((sigmoid(z) >= quality_classifier.CONFIDENT, sigmoid(z) <= 1 - quality_classifier.CONFIDENT)):
                if sure:
                    for f in [*its, -1]:
                        want[other][f, k] += 1
    free = every.join(lab.select("doc_id"), "doc_id", "left_anti").select("words", "stats", "meta")
    got = quality_classifier._teach(free, model.looks, model.views)
    assert all(np.array_equal(got[v], want[v]) for v in want) and got["meta"][-1].min() > 10
    table = np.array([[12.0, 1], [0, 3], [20, 9]])
    assert np.allclose(quality_classifier.log_odds(table), [np.log(13 / 22) - np.log(2 / 11), np.log(1 / 22) - np.log(4 / 11)])
    assert not quality_classifier.log_odds(np.array([[3.0, 0], [5, 0]])).any()
    by = {}
    for r in quality_classifier.score(df, lab).collect():
        by.setdefault(r.doc_id, []).append((r.score, r.text_score, r.meta_score, r.kept))
    for key, s in scores.items():
        assert any(s == pytest.approx(g[:3], abs=1e-6) and g[3] == (bool((key[1] or "").split()) and s[0] >= model.threshold) for g in by[key[0]])


def test_words_are_chosen_without_the_rows_for_calibration(spark):
    """A word that tells the label among calibration rows alone is not looked at."""
    docs, labels, _ = junk_corpus(900)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in quality_classifier._labelled(lab, 12_000).where("calibrate").collect()}
    assert 100 < len(held) < 300
    kind = {i: q for i, q, _ in labels}
    marked = [(i, t + (" leaked" if i in held and kind[i] else " honest" if i not in held and kind.get(i) else "")) for i, t in docs]
    model, _ = quality_classifier.train(frame(spark, marked), lab)
    seen = lambda w: int(next(chunks([pa_batch(w)], quality_classifier.ALNUM, lower=True))[0].word_hash[0]) in {int(h) for h in model.looks.words}
    assert seen("honest") and not seen("leaked")


def test_views_teach_each_other():
    """With few labels, what one view is sure of helps the other: its words are known only from unlabelled rows."""
    rng = np.random.default_rng(1)
    n, words = 4000, 40
    y = (rng.random(n) < 0.5).astype(float)
    # each text has three of twenty words of its kind; metadata tell the label by a number
    word = rng.integers(0, words // 2, (n, 3)) + (y[:, None] > 0) * (words // 2)
    word = np.where(rng.random((n, 3)) < 0.1, rng.integers(0, words, (n, 3)), word)
    text = quality_classifier.Sparse(word.ravel(), np.full(n, 3), np.zeros((n, 0)), words)
    size = np.clip(np.round(y * 6 + rng.normal(size=n)), -3, 9).astype(np.int64) + 3
    meta = quality_classifier.Sparse(size, np.ones(n, np.int64), np.zeros((n, 0)), 13)
    first = np.arange(n) < 40
    calibrate, free = np.arange(40) % 4 == 0, ~first
    teach = lambda views: quality_classifier.lessons(views, text.take(free), meta.take(free))
    right = {}
    for rounds in (0, 3):
        views, mix, threshold = quality_classifier.cotrain(text.take(first), meta.take(first), y[first], calibrate, teach, rounds)
        right[rounds] = np.mean((views["text"].logit(text.take(free)) > 0) == (y[free] > 0))
        assert mix[0] > 0 and mix[1] > 0 and 0 <= threshold <= 0.5
    assert right[3] > right[0] + 0.01 and right[3] > 0.97
