"""Pair rules in order: events, loose ones, talk, and where a new report goes.

Reports are those of session.reports (a headline is a text's first line); a report's kind is whether its text gives
figures, its speaker the first word of the headline.  Null headlines and texts have no words, figures or speaker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import sets, text
from tideline.lineage import cut
from tideline.operators.pairrules import Rule, homes, matches
from tideline.plans.similar import _HEAD
from tideline.session import REPORTS, reports


def cards(spark, sf_dir):
    """Reports as slim rows (words, figures, speaker), written once: rules that read them again do not read the texts again."""
    found = F.regexp_extract_all("text", F.lit("0*([0-9]+)"), F.lit(1))  # as they are written: of any length
    r = reports(spark, sf_dir).select("fp", "at", "source", "desk", "summary", "text")
    none = F.array().cast("array<string>")
    slim = r.select(
        "fp", "at", "source", "desk", F.coalesce(text.norm(F.col("summary")), F.lit("")).alias("norm"), F.coalesce(text.head_words(F.col("summary")), none).alias("w"),
        F.coalesce(F.array_distinct(found), none).alias("figures"),
        F.regexp_extract(F.lower("summary"), r"^([\p{L}]+)", 1).alias("speaker"),
    ).withColumn("kind", F.size("figures") > 0)
    return cut(slim)


def _under(*parts, each):
    """One key for each element, under the values that must be equal, too."""
    return F.transform(each, lambda x: F.concat_ws("\x1f", *parts, x))


def block(least, *parts):
    """One key of the values that must be equal, for reports with so many words at least."""
    return F.when(F.size("w") >= least, F.array(F.concat_ws("\x1f", *parts)))


def _same(*names):
    return reduce(lambda a, b: a & b, (F.col(n) == F.col(f"{n}_e") for n in names))


def _speaks():
    return _same("desk", "speaker") & (F.col("speaker") != "")


def _shared():
    return sets.shared(F.col("w"), F.col("w_e"))


def _overlap():
    return sets.overlap(F.col("w"), F.col("w_e"))


def event():
    no_news = F.size(F.array_except("figures", "figures_e")) == 0
    alike = (_overlap() >= 0.6) | ((_overlap() >= 0.5) & (_shared() >= 5))
    return [
        Rule("same_headline", 86_400, F.array(F.concat_ws("\x1f", "desk", "source", "norm")), _same("desk", "source", "norm") & (F.length("norm") >= 20)),
        Rule("own_retelling", 43_200, block(1, "desk", "source"), _same("desk", "source") & no_news & alike),
        Rule("two_kinds", 5_400, block(4, "desk"), _same("desk") & (F.col("kind") != F.col("kind_e")) & (_shared() >= 4) & (_overlap() >= 0.6)),
    ]


def loose():
    common, texts = F.array_intersect("figures", "figures_e"), lambda x: x.cast("string")
    return [
        Rule("rare_figure", 43_200, _under("desk", each=F.transform(F.filter("figures", lambda x: F.length(x) >= 3), texts)), _same("desk") & F.exists(common, lambda x: F.length(x) >= 3) & (_shared() >= 2)),
        Rule("same_count", 10_800, _under("desk", each=F.transform("figures", texts)), _same("desk") & F.exists(common, lambda x: (F.length(x) > 1) | (x >= "5")) & (_shared() >= 1)),
    ]


def talk():
    same_day = F.floor(F.col("at") / 86_400) == F.floor(F.col("at_e") / 86_400)
    return [
        Rule("burst", 600, F.array(F.concat_ws("\x1f", "desk", "source", "speaker")), _same("source") & _speaks()),
        Rule("remarks", 86_400, F.array(F.concat_ws("\x1f", "desk", "speaker")), _speaks() & same_day & ((F.col("at") - F.col("at_e") <= 10_800) | (_shared() >= 3))),
    ]


_CARDS = rf"""{REPORTS}, c AS (SELECT fp, at_, source, desk, coalesce(trim(regexp_replace(regexp_replace(lower(summary), '[''’]', '', 'g'), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')), '') AS norm,
  coalesce({_HEAD}, []) AS w, coalesce(list_distinct(regexp_extract_all(text, '0*([0-9]+)', 1)), []) AS f,
  coalesce(regexp_extract(lower(summary), '^([\p{{L}}]+)', 1), '') AS speaker FROM reports),
p AS (SELECT a.fp AS early, b.fp AS late, a.at_ AS t, b.at_ - a.at_ AS gap, a.source = b.source AS own, a.norm AS na, b.norm AS nb, len(list_intersect(a.w, b.w)) AS shared,
  CASE WHEN least(len(a.w), len(b.w)) > 0 THEN CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / least(len(a.w), len(b.w)) ELSE 0 END AS overlap,
  len(list_filter(b.f, lambda x: NOT list_contains(a.f, x))) AS new_figures, list_intersect(a.f, b.f) AS common, (len(a.f) > 0) <> (len(b.f) > 0) AS kinds,
  a.speaker = b.speaker AND a.speaker <> '' AS speaks, a.at_ // 86400 = b.at_ // 86400 AS same_day
  FROM c a JOIN c b ON a.desk = b.desk AND (a.at_, a.fp) < (b.at_, b.fp) AND b.at_ - a.at_ <= 86400)"""
_EVENT = """CASE WHEN own AND na = nb AND length(na) >= 20 THEN 'same_headline'
  WHEN gap <= 43200 AND own AND new_figures = 0 AND (overlap >= 0.6 OR overlap >= 0.5 AND shared >= 5) THEN 'own_retelling'
  WHEN gap <= 5400 AND kinds AND shared >= 4 AND overlap >= 0.6 THEN 'two_kinds' END"""
_LOOSE = """CASE WHEN gap <= 43200 AND len(list_filter(common, lambda x: length(x) >= 3)) > 0 AND shared >= 2 THEN 'rare_figure'
  WHEN gap <= 10800 AND len(list_filter(common, lambda x: length(x) > 1 OR x >= '5')) > 0 AND shared >= 1 THEN 'same_count' END"""
_TALK = "CASE WHEN gap <= 600 AND own AND speaks THEN 'burst' WHEN speaks AND same_day AND (gap <= 10800 OR shared >= 3) THEN 'remarks' END"


def _sql(rule):
    return f"WITH {_CARDS} SELECT early, late, rule FROM (SELECT early, late, {rule} AS rule FROM p) WHERE rule IS NOT NULL"


@query(100, 165, 166, 184, sql=_sql(_EVENT))
def event_rules(spark, sf_dir):
    """Pairs of a desk by the first event rule: the outlet's same headline within a day, its own retelling without a new
    figure within 12 hours, one event told in two kinds within 90 minutes."""
    return matches(cards(spark, sf_dir), event()).drop("place")


@query(101, 156, 167, sql=_sql(_LOOSE))
def loose_rules(spark, sf_dir):
    """Pairs of a desk by a figure: a rare one with two words in common within 12 hours, any from five on with one word
    within three."""
    return matches(cards(spark, sf_dir), loose()).drop("place")


@query(102, 168, 169, sql=_sql(_TALK))
def talk_rules(spark, sf_dir):
    """Pairs of one speaker: of one outlet within ten minutes, else of a day within three hours or with three words in
    common."""
    return matches(cards(spark, sf_dir), talk()).drop("place")


@query(99, sql=f"""WITH {_CARDS}, e AS (SELECT *, {_EVENT} AS r1, {_LOOSE} AS r2, {_TALK} AS r3 FROM p),
o AS (SELECT late, early, t, coalesce(r1, r2, r3) AS rule FROM e),
n AS (SELECT *, CASE rule WHEN 'same_headline' THEN 0 WHEN 'own_retelling' THEN 1 WHEN 'two_kinds' THEN 2 WHEN 'rare_figure' THEN 3 WHEN 'same_count' THEN 4 WHEN 'burst' THEN 5 ELSE 6 END AS place FROM o WHERE rule IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY late ORDER BY place, t, early) AS k FROM n) SELECT late, early AS home, rule FROM k WHERE k = 1""")
def told_before(spark, sf_dir):
    """Where each report goes: the earlier report that the first of all rules finds, of several the earliest."""
    c = cards(spark, sf_dir)
    return homes(matches(c, event() + loose() + talk()), c)


@query(147, 148, 205, 206, sql=f"""WITH {_CARDS}, told AS (SELECT p.early, p.late FROM p WHERE speaks AND gap <= 43200),
b AS (SELECT t.late, a.w AS aw, a.f AS af, l.w AS lw, l.f AS lf FROM told t JOIN c a ON a.fp = t.early JOIN c l ON l.fp = t.late)
SELECT late, count(*) AS tellers, bool_or(len(lw) > 0 AND CAST(len(list_intersect(aw, lw)) AS DOUBLE) >= 0.7 * len(lw)) AS retold,
  CAST(len(list_filter(any_value(lf), lambda x: NOT list_contains(flatten(list(af)), x))) AS INTEGER) AS new_figures,
  CAST(len(list_filter(any_value(lw), lambda x: NOT list_contains(flatten(list(aw)), x))) AS INTEGER) AS new_words FROM b GROUP BY late""")
def brings_news(spark, sf_dir):
    """Beside all earlier reports of its speaker within 12 hours: does a report repeat one (70 % of its words), and what
    figures and words does it add that none of them has."""
    c = cards(spark, sf_dir).select("fp", "at", "desk", "speaker", "w", "figures")
    rule = Rule("speaker", 43_200, F.array(F.concat_ws("\x1f", "desk", "speaker")), _speaks())
    told = matches(c, [rule]).select("early", "late")
    both = told.join(c.select(F.col("fp").alias("early"), F.col("w").alias("aw"), F.col("figures").alias("af")), "early")
    both = both.join(c.select(F.col("fp").alias("late"), F.col("w").alias("lw"), F.col("figures").alias("lf")), "late")
    # What is left of the later report's own words and figures: what it adds beside one report, counted over all of them.
    one = both.select("late", sets.contained(F.col("lw"), F.col("aw")).alias("part"), F.array_intersect("lw", "aw").alias("hw"), F.array_intersect("lf", "af").alias("hf"), F.size("lw").alias("nw"), F.size("lf").alias("nf"))
    seen = one.groupBy("late").agg(F.count("*").alias("tellers"), F.bool_or(F.col("part") >= 0.7).alias("retold"), F.first("nw").alias("nw"), F.first("nf").alias("nf"))
    words = one.select("late", F.explode("hw").alias("x")).groupBy("late").agg(F.count_distinct("x").alias("kw"))
    figures = one.select("late", F.explode("hf").alias("x")).groupBy("late").agg(F.count_distinct("x").alias("kf"))
    out = seen.join(words, "late", "left").join(figures, "late", "left")
    left = lambda n, k: (F.col(n) - F.coalesce(k, F.lit(0))).cast("int")
    return out.select("late", "tellers", "retold", left("nf", "kf").alias("new_figures"), left("nw", "kw").alias("new_words"))
