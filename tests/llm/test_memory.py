"""What the pipeline's stages hold in an executor's memory at once."""

import pyarrow as pa
import pytest

import corpus_pipeline
from talweg.llm import substring_dedup
from talweg.llm._shared import BATCH_BYTES

LONG = " ".join(f"w{k}" for k in range(40))


@pytest.fixture
def docs(spark):
    rows = [(k, f"{LONG} end{k}" if k % 2 else f"other{k} text", None, None, None) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_a_task_of_substring_dedup_holds_one_python_worker(docs):
    """Each side of the union has one Python step; the rows that are cut come from a written table."""
    out = substring_dedup.remove_duplicates(docs, 30)
    sides = out._jdf.queryExecution().executedPlan().toString().split("Union")[1]
    assert sides.count("MapInArrow") == 2
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[1] == f"{LONG} end1" and all(kept[k] == f"end{k}" if k % 2 else kept[k] == f"other{k} text" for k in kept if k > 1) and len(kept) == 40


def test_stages_hand_texts_to_python_by_a_few_megabytes(spark, docs):
    big = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('word ', 2000) text")
    sizes = lambda: [r.n for r in big.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in it), "n long").collect()]
    spark.conf.unset(BATCH_BYTES)
    try:
        corpus_pipeline.repeated_passages(spark, docs, "")
        assert max(sizes()) < 5_000_000
        spark.conf.set(BATCH_BYTES, "8m")
        corpus_pipeline.repeated_passages(spark, docs, "")
        assert 5_000_000 < max(sizes()) < 9_000_000
    finally:
        spark.conf.unset(BATCH_BYTES)
