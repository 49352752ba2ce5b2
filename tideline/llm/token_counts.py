"""Exact histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded with a public tokenizer's merge ranks and aggregated by length: one row for each distinct length
whatever the number of documents.  Suffix sums over the lengths give, for every context limit L, how many documents are
longer, how many tokens there are and how many are left when each document is cut to L tokens; running counts give every
quantile exactly.

Running sums go by blocks of `block` lengths (block totals first, then places inside a block), so that a corpus with very
many distinct lengths is not gathered in a task.

Defined results: null and empty texts have length 0; a null weight of rows does not exist (each row counts once, repeated
rows too); an empty table gives no rows.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.scratch import Scratch, small_batches

#: Of the public byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def with_length(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """docs with n_tokens. The ranks (a vocabulary file of a few MB) are read once and broadcast."""
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(_ranks(tokenizer))
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "n_tokens"))
    at = kept.columns.index(text_col)

    def rows(batches):
        encode = None
        for batch in batches:
            encode = encode or tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
            n = [len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    return kept.mapInArrow(rows, T.StructType([*kept.schema, T.StructField("n_tokens", T.LongType())]))


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(length, n_docs) of a length column, written once: what reads it again does not encode the corpus again."""
    found = lengths.groupBy(F.col(length_col).alias("length")).agg(F.count("*").alias("n_docs"))
    return Scratch(lengths.sparkSession, "token-counts").put(found)


def answers(hist: DataFrame, block: int = 4096) -> DataFrame:
    """Per distinct length: n_docs, docs_from (this long or longer), tokens_from, docs_to (this long or shorter), tokens_to,
    truncated_total (all tokens with documents cut to this length) and quantile (share of documents up to it)."""
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / block).alias("block"))
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    every = Window.partitionBy()
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "block", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
        F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sofar = h.select("length", "n_docs", "n_tokens", "block", F.sum("n_docs").over(inside).alias("d"), F.sum("n_tokens").over(inside).alias("t")).join(starts, "block")
    docs_to, tokens_to = F.col("d0") + F.col("d"), F.col("t0") + F.col("t")
    docs_from, tokens_from = F.col("all_docs") - docs_to + F.col("n_docs"), F.col("all_tokens") - tokens_to + F.col("n_tokens")
    return sofar.select(
        "length", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), docs_to.alias("docs_to"), tokens_to.alias("tokens_to"),
        (tokens_to + F.col("length") * (docs_from - F.col("n_docs"))).alias("truncated_total"), (docs_to / F.col("all_docs")).alias("quantile"),
    )


def truncated(hist_answers: DataFrame, limits: DataFrame, limit_col: str = "context", block: int = 4096) -> DataFrame:
    """limits with the documents that fit, and the total of tokens with documents cut to the limit: an as-of lookup of the
    greatest length that is no more than the limit, inside the limit's block of lengths, else in the nearest block below.
    A null or negative limit fits nothing and keeps 0 tokens."""
    found = F.struct("length", "docs_to", "tokens_to")
    known = hist_answers.select(F.floor(F.col("length") / block).alias("block"), F.col("length").alias("at"), found.alias("a"), F.lit(False).alias("asked"))
    limit = F.greatest(F.coalesce(F.col(f"`{limit_col}`").cast("long"), F.lit(0)), F.lit(0))
    asked = limits.select(
        F.floor(limit / block).alias("block"), limit.alias("at"), F.lit(None).cast(known.schema["a"].dataType).alias("a"), F.lit(True).alias("asked"),
        F.col(f"`{limit_col}`").cast("long").alias(limit_col),
    )
    inside = Window.partitionBy("block").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = known.unionByName(asked, allowMissingColumns=True).withColumn("near", F.last("a", True).over(inside)).filter("asked")
    # One row a block of either side: windows over them are small.
    ends = known.groupBy("block").agg(F.max("a").alias("end")).join(both.select("block").distinct(), "block", "full")
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("block", F.last("end", True).over(below).alias("far"))
    docs = hist_answers.agg(F.coalesce(F.max("docs_to"), F.lit(0)).alias("docs"))  # one row
    out = both.join(ends, "block").crossJoin(F.broadcast(docs)).withColumn("a", F.coalesce("near", "far"))
    fit, kept, valid = F.coalesce(F.col("a.docs_to"), F.lit(0)), F.coalesce(F.col("a.tokens_to"), F.lit(0)), F.coalesce(F.col(limit_col) >= 0, F.lit(False))
    return out.select(
        limit_col, F.when(valid, fit).otherwise(0).cast("long").alias("docs_fit"),
        F.when(valid, kept + F.col("at") * (F.col("docs") - fit)).otherwise(0).cast("long").alias("truncated_total"),
    )
