"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept;
the last returns each document as often as the mixture reads it, numbered by ``copy``.

Defined cases, for all stages: an empty table gives no rows; every column stays, whatever
its name; repeated rows are rows of their own unless a stage says otherwise; texts are read
whole, however long. The stages set spark.sql.execution.arrow.maxBytesPerBatch to 4 MB where the
session has no value for it. What a stage writes on its way is deleted once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talweg.llm import decontamination, minhash_dedup, quality_classifier, source_mixing, substring_dedup
from talweg.llm._shared import cut, drop_cut, scratch, small_batches

SHINGLE, PERCENT = 5, 80  # words of a shingle; least similarity of near duplicates
PASSAGE = 30  # words from which a passage that stands earlier is removed
WINDOW, COVERED = 10, 0.5  # words of a benchmark match; share of matched words from which a document goes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the classifier rejects: those without words, and by score; each row by itself, with an id or without."""
    small_batches(spark)
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One doc_id of each group; rows of one doc_id are one document and stay together; rows without id or words stay."""
    small_batches(spark)
    return minhash_dedup.keep_one(docs, SHINGLE, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that stand earlier in the order of doc_id, rows without one last; a document of which nothing is left goes."""
    small_batches(spark)
    return substring_dedup.remove_duplicates(docs, PASSAGE)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of the benchmark's items, with an id or without; each row by its own text."""
    small_batches(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW, COVERED)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate says; null is a source of its own, and rows of one doc_id fare alike."""
    return source_mixing.emit(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark),
    ("source mixing", mixture),
]

#: The classifier and MinHash stages have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as kept:
            done = cut(stage(spark, docs, sf_dir))
            kept.append(done)
        drop_cut(docs)  # nothing for the table of documents itself
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
