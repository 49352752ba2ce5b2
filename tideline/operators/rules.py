"""Ordered rule tables as column expressions: first match, additive scores, multi-label routing, and their evaluation.

A rule table of patterns is a list on the driver (tens to hundreds of rules); it compiles to one expression inside
whole-stage code, so classifying never joins or leaves the JVM.  A rule table of words is a DataFrame of any size: it meets
the distinct words of each text by an equi-join (word_rules).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    weight: int = 0


def first_match(text: Column, rules: list[Rule], default: str | None = None) -> Column:
    """Name of the first rule whose pattern the text has."""
    return F.coalesce(*(F.when(text.rlike(r.pattern), r.name) for r in rules), F.lit(default))


def score(text: Column, rules: list[Rule], least: int = 0, most: int = 100) -> Column:
    """Sum of the weights of all rules that match, held within bounds."""
    total = sum((F.when(text.rlike(r.pattern), r.weight).otherwise(0) for r in rules), F.lit(0))
    return F.greatest(F.lit(least), F.least(F.lit(most), total))


def labels(text: Column, rules: list[Rule], default: str | None = None) -> Column:
    """Names of all rules that match; the default alone where none does."""
    found = F.array_compact(F.array(*(F.when(text.rlike(r.pattern), r.name) for r in rules)))
    return found if default is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def verdict(points: Column, feed: Column, tray: Column) -> Column:
    return F.when(points >= feed, "feed").when(points >= tray, "tray").otherwise("exclude")


def evaluate(judged: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """Recall, precision, specificity and exact share of boolean columns, by group or overall."""
    t, p = F.col(truth), F.col(predicted)
    share = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 6)
    return judged.groupBy(*by).agg(
        F.count("*").alias("n"), share(t & p, t).alias("recall"), share(t & p, p).alias("precision"),
        share(~t & ~p, ~t).alias("specificity"), F.round(F.count_if(t == p) / F.count("*"), 6).alias("exact"),
    )


def word_rules(texts: DataFrame, key: str, words: Column, rules: DataFrame) -> DataFrame:
    """(key, points, kind, labels, n_rules) by a table of rules (word, weight, kind, label, priority): points are the sum of
    the weights of all rules whose word a text has, each once; kind is that of the first by priority, then word; labels are
    all their labels, in order. Texts that no rule fits have 0 points, no kind and no labels.

    Texts shuffle by word once; a word that very many texts have is split by AQE, or the table broadcast if its size at run
    time allows. A key must be unique; null words match nothing, of equal rules of a word each counts."""
    own = texts.select(key, F.explode(F.array_distinct(words)).alias("word"))
    hit = own.join(rules.filter("word is not null"), "word").groupBy(key).agg(
        F.sum("weight").alias("points"), F.min(F.struct("priority", "word", "kind")).alias("m"), F.array_sort(F.array_distinct(F.array_compact(F.collect_list("label")))).alias("labels"), F.count("*").alias("n_rules")
    )
    out = texts.select(key).join(hit, key, "left")
    return out.select(key, F.coalesce("points", F.lit(0)).alias("points"), F.col("m.kind").alias("kind"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"))
