"""Exact histogram of encoded document lengths, and what its suffix sums answer.

Each task encodes its documents and counts them by length, so the shuffle carries one row
for each task and length. Running totals go over blocks of lengths first and then within
each block, so no task sees every length.

Defined cases: a null or empty text has 0 tokens and counts as a document; repeated rows
count each time; an empty table gives no rows; other columns of the table are ignored; a very long text
is encoded in parts of ``PART`` characters cut before white space that follows a word, where the split pattern
always cuts, so its length is the same and memory stays bounded.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.llm._shared import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split pattern that belongs to the byte-level vocabulary: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 128
PART = 1 << 20


@lru_cache(maxsize=2)
def _encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def encoded_lengths(texts: list[str | None], ranks: bytes) -> list[int]:
    """Tokens of each text; special tokens in a text are ordinary text."""
    encode = _encoder(ranks).encode_ordinary
    return [sum(len(encode(x)) for x in _parts(t)) if t else 0 for t in texts]


_BORDER = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")  # one space between letters: the pattern cuts before it


def _parts(text: str, most: int = 0):
    """text in parts of about ``most`` characters that encode like the whole."""
    most, at = most or PART, 0
    while len(text) - at > most and (cut_at := _BORDER.search(text, at + most)):
        yield text[at : cut_at.start()]
        at = cut_at.start()
    yield text[at:]


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): documents of each encoded length.

    The vocabulary file is read by the driver and sent to the tasks; a vocabulary has a
    fixed size (about 1 MB).
    """
    spark = docs.sparkSession
    if not Path(vocabulary).is_file():
        raise FileNotFoundError(f"no vocabulary at {vocabulary}: give the path of a .tiktoken file as ``vocabulary``")
    ranks = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for a in range(0, b.num_rows, 256):
                seen.update(encoded_lengths(b.column(0).slice(a, 256).to_pylist(), ranks.value))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each length L that occurs.

    tokens: of documents of that length; docs_ge, tokens_ge: of those of L tokens or more;
    docs_le: of L or fewer; total_docs, total_tokens: of all; truncated_total: tokens left
    if every document is cut to L; quantile: share of documents of L tokens or fewer.
    """
    h = cut(hist).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / block))
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each BLOCK lengths that occur: texts of up to 10**8 tokens give under a million
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    above = blocks.select("block", F.coalesce(F.sum("bd").over(down), F.lit(0)).alias("d_above"), F.coalesce(F.sum("bt").over(down), F.lit(0)).alias("t_above"))
    total = blocks.agg(F.sum("bd").alias("total_docs"), F.sum("bt").alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.withColumn("d_in", F.sum("n_docs").over(inside)).withColumn("t_in", F.sum("tokens").over(inside))
    out = out.join(above, "block").crossJoin(F.broadcast(total))  # total: one row
    docs_ge, tokens_ge = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    docs_gt = docs_ge - F.col("n_docs")
    return out.select(
        "n_tokens",
        "n_docs",
        "tokens",
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        (F.col("total_docs") - docs_gt).alias("docs_le"),
        (F.col("total_tokens") - tokens_ge + F.col("n_tokens") * docs_ge).alias("truncated_total"),
        ((F.col("total_docs") - docs_gt) / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_over, docs_fitting, truncated_total) for each context limit of a stated list, present as a length or not; one pass over the lengths."""
    whole = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")

    def row(x: int):
        over = F.col("n_tokens") > x
        return F.struct(F.lit(x).cast("long").alias("context"), whole(F.when(over, F.col("n_docs"))).alias("docs_over"), whole(F.when(~over, F.col("n_docs"))).alias("docs_fitting"), whole(F.when(over, x * F.col("n_docs")).otherwise(F.col("tokens"))).alias("truncated_total"))

    return sums.agg(F.array(*(row(int(x)) for x in sorted(set(limits)))).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of the documents keeps to, for a stated list of shares."""
    least = lambda x: F.struct(F.lit(x).alias("share"), F.min(F.when(F.col("quantile") >= x, F.col("n_tokens"))).alias("n_tokens"))
    return sums.agg(F.array(*(least(float(x)) for x in sorted(set(shares)))).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
