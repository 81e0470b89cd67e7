import random

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted junk, copies, passages and leaks."""
    rnd = random.Random(21)
    word = lambda: f"w{rnd.randrange(5000)}"
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(30)
    passage = prose(60)
    docs, kind = [], {}

    def add(text, what):
        kind[len(docs)] = what
        docs.append((len(docs), text, "en", f"s{len(docs) % 4}", len(text)))

    for _ in range(240):
        add(prose(rnd.randint(60, 150)), "clean")
    for k in range(80):
        add((prose(80).upper()).replace(" ", "!! "), "junk")
    for k in range(12):
        add(docs[k][1], "exact")
        near = docs[20 + k][1].split()
        near[5] = "changed"
        add(" ".join(near), "near")
        add(f"{prose(50)} {passage} {prose(50)}", "passage")
        add(f"{prose(60)} {item} {prose(60)}", "leak")
    labels = [(i, int(kind[i] != "junk"), 0) for i in range(0, len(docs), 2)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, kind, item, passage


def test_each_stage_on_its_own_input(spark, folder, tmp_path):
    path, kind, item, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, rows = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, path)
        assert out.columns[: len(columns)] == columns and (k == len(corpus_pipeline.STAGES) - 1) == (len(out.columns) > len(columns))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        rows[name] = (before, {r.doc_id: r.text for r in after}, len(after))
    before, after, _ = rows["quality classifier"]
    assert not any(kind[i] == "junk" for i in after) and sum(i in after for i in kind if kind[i] != "junk") >= 0.98 * sum(v != "junk" for v in kind.values())
    before, after, _ = rows["MinHash near-dedup"]
    groups = brute.near_groups(list(before.items()), 5, 80)
    assert set(after) == {i for i, (_, r) in groups.items() if i == r} and all(after[i] == before[i] for i in after)
    before, after, _ = rows["substring dedup"]
    want = brute.substring(list(before.items()), corpus_pipeline.PASSAGE)
    assert set(after) == {i for i, (n, gone, _) in want.items() if n == 0 or gone < n}
    assert all(brute.sha(b" ".join(brute.words(t))) == want[i][2] for i, t in after.items())
    assert sum(passage in t for t in after.values()) == 1
    before, after, _ = rows["benchmark decontamination"]
    hit = brute.contaminated(list(before.items()), [(1, item)])
    assert all(after[i] == t for i, t in before.items() if not hit[i][1])
    assert all(not v[1] for v in brute.contaminated(list(after.items()), [(1, item)]).values())
    before, after, n = rows["source mixing"]
    assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    # each source's words come near its level, and every copy is numbered
    words = lambda t: len(brute.words(t))
    source = {i: f"s{i % 4}" for i in kind}
    size, taken, copies = {}, {}, {}
    for i, t in before.items():
        size[source[i]] = size.get(source[i], 0) + words(t)
    for r in docs.collect():
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + words(r.text)
        copies.setdefault(r.doc_id, []).append(r["copy"])
    want = brute.level_targets(size)
    assert all(abs(taken[s] - want[s]) < 0.2 * want[s] for s in want)
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) in (int(want[source[i]] / size[source[i]]), int(want[source[i]] / size[source[i]]) + 1) for i, c in copies.items())


def test_stages_take_odd_rows(spark, folder):
    """Null, empty and repeated rows, rows without an id, and columns whose names the stages use themselves."""
    path, kind, item, _ = folder
    plain = spark.read.parquet(f"{path}/documents.parquet")
    good = plain.where("doc_id = 3").first().text
    odd = [(None, None), (None, ""), (9000, None), (9001, " "), (None, good), (None, good), (9002, f"{good} one"), (9002, f"{good} one"), (None, item), (9003, "x" * 50000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in odd], schema)
    names = ("copy", "key", "doc", "h", "_key", "_spans", "_doc_key", "_source", "component_id", "kept", "row")
    docs = plain.unionByName(extra).select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        rows = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns and rows, name
        assert all(r[n] == k for r in rows for k, n in enumerate(names)), name
        texts = [(r.doc_id, r.text) for r in rows if r.doc_id is None or r.doc_id >= 9000]
        if name == "quality classifier":
            assert not any(t is None or not t.split() for _, t in texts) and texts.count((None, good)) == 2
        elif name == "MinHash near-dedup":
            assert texts.count((None, good)) == 2 and (9002, odd[6][1]) not in texts and {(None, None), (None, ""), (9000, None), (9001, " ")} <= set(texts)
        elif name == "substring dedup":
            assert (None, good) not in texts and {(None, None), (9000, None), odd[9]} <= set(texts)
        elif name == "benchmark decontamination":
            assert (None, item) not in texts and texts.count((None, good)) == 2 and len(texts) == len(odd) - 1
        else:
            assert out.columns[-1] == "copy_" and all(r["copy_"] >= 1 for r in rows)
        assert stage(spark, docs.where("false"), path).count() == 0, name


def test_run_goes_through_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    got = out.collect()
    assert got and out.columns[-1] == "copy" and not any(folder[1][r.doc_id] == "junk" for r in got)
    assert len({(r.doc_id, r["copy"]) for r in got}) == len(got)


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{k}_" for k in range(1, 14)} == {n.split("_")[0] + "_" for n in names if n[:2] == "op" and n[2].isdigit()} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
