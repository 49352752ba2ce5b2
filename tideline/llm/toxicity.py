"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (lengths `lengths`) of the whole lower-cased text, hashed into `buckets`.  On labelled
text each feature gets its log-count ratio r = ln((p / |p|) / (q / |q|)) from smoothed counts of documents of either label
(Wang and Manning, 2012); a text is the vector of r over its features, and logistic regression on these vectors gives the
weights.  Features whose ratio is within `least_z` standard errors of 0 are left out, so the many n-grams that say
nothing do not add up in long texts; all others stay, however many.  The regression is Spark ML's: gradients are summed on
executors over the rows of the sample, the driver holds a few numbers for each feature that stays, of which there are no
more than buckets.

Fitting takes at most `rows` labelled documents that are not held out, half of them of either label (those with the
smallest hash of their id; the ids are broadcast, two longs a row), with weights that restore the labels' shares;
everything else covers all rows.

Defined results: null and empty texts have no features and score by the intercept; a document labelled twice is toxic if
any label says so, null labels do not count, nor do labels without a document; of rows that repeat an id one is learned
from; labels of one kind or none leave a constant score; repeated rows score alike; other columns pass through, and one
named score is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.scan import U, mix
from tideline.llm.scratch import Scratch, small_batches

LENGTHS = (3, 4, 5, 6, 7)
BUCKETS = 1 << 20
_CHUNK = 1 << 20


@dataclass
class Toxicity:
    """slot[bucket]: the feature's place in value, or the last place, which is worth nothing."""

    slot: np.ndarray
    value: np.ndarray
    intercept: float


def text_grams(texts: list[str | None], lengths: tuple[int, ...] = LENGTHS, buckets: int = BUCKETS):
    """Buckets of the n-grams of each text, one array a text, with repeats."""
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size < _CHUNK):
            some.append((texts[at] or "").lower())
            size += len(some[-1])
            at += 1
        codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        hashed = []
        for n in lengths:
            m = len(codes) - n + 1
            h = np.full(max(m, 0), n, np.uint64)
            for k in range(n):
                h += codes[k : k + m] * U(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) if m > 0 else U(0)
            hashed.append((mix(h) % U(buckets)).astype(np.int32) if m > 0 else np.zeros(0, np.int32))
        start = 0
        for t in some:
            end = start + len(t)
            yield np.concatenate([h[start : end - n + 1] if len(t) >= n else h[:0] for n, h in zip(lengths, hashed)])
            start = end


def _counts(batches):
    """Documents of a task that have each bucket, by label."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for grams, toxic in zip(text_grams(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
            seen[toxic][np.unique(grams)] += 1
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.record_batch([pa.array(at), pa.array(seen[0][at]), pa.array(seen[1][at])], ["bucket", "clean", "toxic"])


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(text, toxic, weight) of at most rows / 2 documents of either label; weight: documents that each stands for."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = known.join(texts.select("id"), "id", "left_semi")
    per_label, most = known.groupBy("toxic").agg(F.count("*").alias("many")), rows // 2
    chosen = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).join(F.broadcast(per_label), "toxic").withColumn("weight", F.col("many") / F.least("many", F.lit(most)))
    found = texts.join(F.broadcast(chosen), "id")
    return found.groupBy("id", "toxic", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic", "weight")


def clear_features(counts: DataFrame, smoothing: float, least_z: float) -> DataFrame:
    """(bucket, ratio): the log-count ratios of counts (bucket, clean, toxic) that are least_z standard errors from 0."""
    p, q = F.col("toxic") + smoothing, F.col("clean") + smoothing
    total = counts.agg(F.sum(p).alias("all_p"), F.sum(q).alias("all_q"))  # one row
    both = counts.crossJoin(F.broadcast(total)).withColumn("ratio", F.log(p / F.col("all_p")) - F.log(q / F.col("all_q")))
    return both.filter(F.abs("ratio") >= least_z * F.sqrt(1 / p + 1 / q)).select("bucket", "ratio")


def fit(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows: int = 20_000, smoothing: float = 1.0, least_z: float = 3.0, l2: float = 1e-4, steps: int = 60,
) -> Toxicity:
    """The classifier; docs and labels are rows that may be learned from."""
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    chosen = scratch.put(sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, rows=rows))
    counts = chosen.select("text", "toxic").mapInArrow(_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    clear = clear_features(scratch.put(counts), smoothing, least_z).toPandas().sort_values("bucket")
    kept, value = clear["bucket"].to_numpy(np.int64), clear["ratio"].to_numpy(float)
    slot = np.full(BUCKETS, len(kept), np.int32)
    slot[kept] = np.arange(len(kept))
    share = {r["toxic"]: r["w"] for r in chosen.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
    prior = np.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1))
    if len(share) < 2 or not len(kept):
        return Toxicity(slot, np.zeros(len(kept) + 1), float(prior))
    shared, nothing = spark.sparkContext.broadcast((slot, value)), len(kept)

    def features(batches):
        own = shared.value[0]
        for batch in batches:
            found = [np.unique(s[s < nothing]) for s in (own[g] for g in text_grams(batch.column(0).to_pylist()))]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["found", "toxic", "weight"])

    vector = F.udf(lambda found: Vectors.sparse(nothing, found, shared.value[1][found]), VectorUDT())
    train = chosen.select("text", F.col("toxic").cast("double").alias("toxic"), "weight").mapInArrow(features, "found array<int>, toxic double, weight double")
    regression = LogisticRegression(featuresCol="x", labelCol="toxic", weightCol="weight", regParam=l2, standardization=False, maxIter=steps)
    model = regression.fit(scratch.put(train.select(vector("found").alias("x"), "toxic", "weight")))
    return Toxicity(slot, np.append(model.coefficients.toArray() * value, 0.0), float(model.intercept))


def score(spark: SparkSession, docs: DataFrame, model: Toxicity, *, text_col: str = "text") -> DataFrame:
    """docs with score, the probability of label 1."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "score"))
    at = kept.columns.index(text_col)

    def rows(batches):
        for batch in batches:
            m = shared.value
            nothing = len(m.value) - 1
            margins = np.array([m.value[np.unique(s[s < nothing])].sum() for s in (m.slot[g] for g in text_grams(batch.column(at).to_pylist()))] or [0.0])[: batch.num_rows]
            scores = 1 / (1 + np.exp(-np.clip(margins + m.intercept, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(rows, T.StructType([*kept.schema, T.StructField("score", T.DoubleType())]))
