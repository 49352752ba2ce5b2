"""The corpus pipeline: language ID, line dedup, near duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on every row it is given and returns the columns of documents, the last one
the mix: (doc_id, source, size, target, taken).  A stage's own rules for nulls, empty texts, ties and repeated rows are in
its operator's docstring; rows with a null doc_id pass the stages that compare documents. Rows that repeat a doc_id are
documents of their own where their texts are not alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import language_id
from tideline.llm.decontaminate import decontaminate
from tideline.llm.line_dedup import dedup_lines
from tideline.llm.mixing import mix
from tideline.llm.ngram_join import ngram_jaccard_join
from tideline.llm.scratch import Scratch


def _with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns given, with the text of another column and its length in characters."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return df.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressors tell; others go."""
    model = language_id.fit(language_id.training_rows(docs))
    return language_id.identify(docs, model).filter("not rejected").select(*(F.col(f"`{c}`") for c in docs.columns))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted; a document of which nothing is left goes."""
    out = dedup_lines(spark, docs).filter("n_removed = 0 or clean_text <> ''")
    return _with_text(out, docs.columns, "clean_text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one document stays: the smallest id, of rows with that id the text with the least
    hash, of rows with that text, too, the least other columns."""
    found = ngram_jaccard_join(spark, docs, n=5, percent=80).documents.filter("id = component")
    # A class is named by its least id: of the rows with that id one stays, and one of every other class that it names.
    roots = found.groupBy(F.col("id").alias("doc_id"), F.coalesce("group", "text_hash")).agg(F.min("text_hash").alias("_hash")).select("doc_id", "_hash").distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.withColumn("_hash", F.xxhash64("text")).filter("doc_id is not null")
    kept = named.join(roots.hint("merge"), ["doc_id", "_hash"], "left_semi").groupBy("doc_id", "_hash").agg(
        F.min(F.struct(F.lit(0).alias("_"), *others)).alias("_rest"), F.min("text").alias("text")
    )
    kept = kept.select("doc_id", "text", *(F.col(f"_rest.`{c}`").alias(c) for c in others))
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; a document that had nothing else goes."""
    out = decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return _with_text(out.filter("coalesce(n_hit, 0) = 0 or n_hit < n_words"), docs.columns, "clean_text")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, in the order of the mix."""
    out = mix(spark, docs, weights=(5, 2, 1), most_repeats=3, keep=["doc_id", "source"])
    return out.select("doc_id", "source", "size", "target", "taken")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("decontaminate", without_benchmarks),
    ("mixing", mixed),
]

#: Alignment and compression have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.put(docs)
    return docs
