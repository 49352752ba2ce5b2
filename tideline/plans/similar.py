"""Near-duplicate reports: similarity pairs, greedy folds, already-told filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import sets, text
from tideline.operators import fold, joins
from tideline.session import REPORTS, reports, table

_STOPS = ", ".join(f"'{w}'" for w in text.STOP)
_HEAD = rf"""list_distinct(list_transform(list_filter(regexp_split_to_array(lower(regexp_replace(summary, '^[^:]{{1,40}}:\s', '')), '[^\p{{L}}\p{{Nd}}]+'),
  lambda w: w <> '' AND NOT list_contains([{_STOPS}], w) AND length(w) >= 3), lambda w: regexp_replace(w, '(ing|ed|es|s)$', '')))"""
_PAIRS = f"""{REPORTS}, h AS (SELECT fp, doc_id, at_, desk, source, summary, {_HEAD} AS w FROM reports), ok AS (SELECT * FROM h WHERE len(w) > 0),
p AS (SELECT a.fp AS early, b.fp AS late, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) AS similarity, a.at_ AS ea, b.at_ AS la
  FROM ok a JOIN ok b ON a.desk = b.desk AND (a.at_, a.fp) < (b.at_, b.fp) AND b.at_ - a.at_ <= 43200)"""


def headlines(spark, sf_dir):
    return reports(spark, sf_dir).withColumn("w", text.head_words(F.col("summary")))


def pairs(spark, sf_dir, least=0.4, within=43200):
    return fold.jaccard_pairs(headlines(spark, sf_dir), key="fp", block=["desk"], at="at", words=F.col("w"), least=least, within=within)


@query(139, 141, 188, 191, sql=f"WITH {_PAIRS} SELECT early, late, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.4")
def same_words(spark, sf_dir):
    """Pairs of a desk within 12 hours whose headline words are alike (Jaccard of 0.4 or more)."""
    return pairs(spark, sf_dir).select("early", "late", F.round("similarity", 6).alias("similarity"))


@query(140, 142, 190, 203, sql=f"""WITH {REPORTS}, h AS (SELECT conv_id, turn, {_HEAD.replace('summary', 'text')} AS w FROM conversations)
SELECT a.conv_id, b.turn, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS shared,
  round(CASE WHEN least(len(a.w), len(b.w)) > 0 THEN CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / least(len(a.w), len(b.w)) ELSE 0 END, 6) AS overlap,
  CAST(len(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) AS INTEGER) AS new_words
FROM h a JOIN h b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def follow_overlap(spark, sf_dir):
    """Each turn beside the one before: shared words, overlap of the smaller set, words it adds."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.head_words(F.col("text")).alias("w"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("v"))
    both = c.join(before, ["conv_id", "turn"])
    return both.select("conv_id", "turn", sets.shared(F.col("v"), F.col("w")).alias("shared"), F.round(sets.overlap(F.col("v"), F.col("w")), 6).alias("overlap"), F.size(F.array_except("w", "v")).alias("new_words"))


@query(98, 202, 415)
def folded(spark, sf_dir):
    """Greedy fold: each copy with the first earlier home whose headline matches; homes with the copies they take."""
    homes = fold.first_homes(pairs(spark, sf_dir), reports(spark, sf_dir), "fp", "at")
    r = reports(spark, sf_dir).select("fp", "at", "source")
    also = homes.join(r.select(F.col("fp").alias("copy"), "source"), "copy").groupBy("home").agg(F.array_sort(F.collect_set("source")).alias("also"), F.count("*").alias("copies"))
    gone = homes.select(F.col("copy").alias("fp"))
    return r.join(gone, "fp", "left_anti").join(also.withColumnRenamed("home", "fp"), "fp", "left").select("fp", "source", F.coalesce("copies", F.lit(0)).alias("copies"), F.array_join("also", ",").alias("also"))


@query(143, 195, sql=f"""WITH {REPORTS}, k AS (SELECT fp, at_, source, trim(regexp_replace(regexp_replace(lower(summary), '[''’]', '', 'g'), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')) AS norm FROM reports)
SELECT norm, min(fp) AS first_fp, count(*) AS n, count(DISTINCT source) AS sources FROM k WHERE length(norm) >= 20 GROUP BY norm HAVING count(*) > 1""")
def same_headline(spark, sf_dir):
    k = reports(spark, sf_dir).select("fp", "source", text.norm(F.col("summary")).alias("norm")).filter(F.length("norm") >= 20)
    return k.groupBy("norm").agg(F.min("fp").alias("first_fp"), F.count("*").alias("n"), F.count_distinct("source").alias("sources")).filter("n > 1")


@query(204, sql=f"""WITH {_PAIRS} SELECT h.fp FROM h WHERE at_ >= 1704067200 + 43200 AND NOT EXISTS (SELECT 1 FROM p WHERE p.late = h.fp AND similarity >= 0.6)""")
def news_only(spark, sf_dir):
    """Reports that nobody told in the half day before."""
    told = pairs(spark, sf_dir, least=0.6).select(F.col("late").alias("fp")).distinct()
    return reports(spark, sf_dir).filter(F.col("at") >= 1704067200 + 43200).select("fp").join(told, "fp", "left_anti")


@query(154, 175, 414, sql=f"""WITH {REPORTS}, f AS (SELECT fp, source, at_, list_distinct(regexp_extract_all(summary, '0*([0-9]+)', 1)) AS n FROM reports)
SELECT a.fp AS early, b.fp AS late, len(list_intersect(a.n, b.n)) = 0 AS clash FROM f a JOIN f b ON a.source = b.source AND b.at_ > a.at_ AND b.at_ - a.at_ <= 86400 WHERE len(a.n) > 0 AND len(b.n) > 0""")
def figure_clash(spark, sf_dir):
    """Reports of a source within a day that both give figures: do they share one?"""
    n = F.array_distinct(F.regexp_extract_all("summary", F.lit("0*([0-9]+)"), F.lit(1)))
    f = reports(spark, sf_dir).select("fp", "source", "at", n.alias("n")).filter(F.size("n") > 0)
    both = joins.interval_join(f, f, ["source"], "at", 86400).filter("at_r < at")
    return both.select(F.col("fp_r").alias("early"), F.col("fp").alias("late"), (~F.arrays_overlap("n", "n_r")).alias("clash"))


@query(406, 316, 404, sql=f"""WITH {REPORTS}, w AS (SELECT fp, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')) AS w FROM reports)
SELECT fp, round(CASE WHEN list_contains(w, 'the') THEN 1.0 ELSE 0 END + CASE WHEN list_contains(w, 'der') THEN 0.5 ELSE 0 END + CASE WHEN list_contains(w, 'que') THEN 1.0 / 3 ELSE 0 END, 6) AS weight,
  CAST(len(list_intersect(w, ['the', 'der', 'que'])) AS INTEGER) AS carried FROM w""")
def rank_weights(spark, sf_dir):
    w, keys = F.array_distinct(text.words(F.col("text"))), F.array(F.lit("the"), F.lit("der"), F.lit("que"))
    return reports(spark, sf_dir).select("fp", F.round(sets.rank_weighted(keys, w), 6).alias("weight"), sets.shared(w, keys).alias("carried"))
