"""Ranked search: a query is groups of alternatives, all of which a report must meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_score(row_summary: Column, row_text: Column, terms: list[str]) -> Column:
    """3 for a term in the headline, 1 for one in the text only."""
    def any_in(c: Column) -> Column:
        return reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(t)) for t in terms))

    return F.when(any_in(row_summary), 3).when(any_in(row_text), 1).otherwise(0)


def ranked(rows: DataFrame, groups: list[list[str]], limit: int, missing: int = 0) -> DataFrame:
    """Reports that miss at most `missing` groups, best score first, then newest; one pass and a top-k."""
    scores = [group_score(F.col("summary"), F.col("text"), g) for g in groups]
    met = sum((F.when(s > 0, 1).otherwise(0) for s in scores), F.lit(0))
    return rows.withColumn("score", sum(scores, F.lit(0))).filter(met >= len(groups) - missing).orderBy(F.desc("score"), F.desc("at")).limit(limit)


def close(a: Column, b: Column) -> Column:
    """Equal up to one edit, two for words of nine letters; words under five letters must be equal."""
    most = F.when(F.length(a) >= 9, 2).otherwise(1)
    return (a == b) | ((F.length(a) >= 5) & (F.levenshtein(a, b) <= most))


def respelled(words: DataFrame, lexicon: DataFrame, most: int = 3) -> DataFrame:
    """(word, candidate, df): lexicon words that are close() and not equal, the most frequent few of each word.  Words and
    candidates meet on the forms that remain when a letter is dropped, or two of long words, so nothing is compared with
    the whole lexicon; words under four letters have no candidates."""
    def drops(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))

    def forms(c: Column) -> Column:
        once = drops(c)
        twice = F.when(F.length(c) >= 8, F.flatten(F.transform(once, drops))).otherwise(F.array().cast("array<string>"))
        return F.explode(F.array_distinct(F.concat(F.array(c), once, twice)))

    w = words.filter(F.length("word") >= 4).select("word", forms(F.col("word")).alias("form"))
    x = lexicon.select(F.col("word").alias("candidate"), "df", forms(F.col("word")).alias("form"))
    far = F.when(F.length("word") >= 9, 2).otherwise(1)
    pairs = w.join(x, "form").select("word", "candidate", "df").distinct().filter((F.col("word") != F.col("candidate")) & (F.levenshtein("word", "candidate") <= far))
    order = Window.partitionBy("word").orderBy(F.desc("df"), "candidate")
    return pairs.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")
