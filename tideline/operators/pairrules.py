"""Ordered pair rules: of the rules that an earlier and a later report meet, the first in order names the pair.

Every rule has its own block keys and time window, so its candidates come from an equi-join on key and time bucket; pairs
are judged by the rule's condition right there, and only matches go on.  A rule whose condition asks for words in common
blocks on what else must be equal (desk, source) and judges the words: a report stands once or twice in a block, whatever its
length, while a key for every word would repeat it, with all its words, as often as it has words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.joins import interval_join


@dataclass
class Rule:
    """keys: strings that two reports must share one of; condition: over the later report's columns and, with the suffix
    `_e`, the earlier one's."""

    name: str
    within: int
    keys: Column
    condition: Column


def matches(cards: DataFrame, rules: list[Rule], key: str = "fp", at: str = "at", **more: Column) -> DataFrame:
    """(early, late, place, rule) and `more`, columns over both reports as conditions are: each pair once, with the first rule
    that it meets. Reports at one time go by key; null conditions are not met; reports without keys match nothing."""
    found = []
    of_pair = [c.alias(name) for name, c in more.items()]
    for place, rule in enumerate(rules):
        keyed = cards.withColumn("_k", F.explode(F.array_distinct(rule.keys))).filter("_k is not null")
        pairs = interval_join(keyed, keyed, ["_k"], at, rule.within, suffix="_e")
        earlier = F.struct(F.col(f"{at}_e"), F.col(f"{key}_e")) < F.struct(F.col(at), F.col(key))
        found.append(pairs.filter(earlier & rule.condition).select(F.col(f"{key}_e").alias("early"), F.col(key).alias("late"), F.struct(F.lit(place).alias("place"), F.lit(rule.name).alias("rule"), *of_pair).alias("m")))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("early", "late").agg(F.min("m").alias("m")).select("early", "late", "m.place", "m.rule", *(f"m.{name}" for name in more))


def homes(found: DataFrame, cards: DataFrame, key: str = "fp", at: str = "at") -> DataFrame:
    """(late, home, rule): where each later report goes, by the first rule and then the earliest report."""
    t = cards.select(F.col(key).alias("early"), F.col(at).alias("t"))
    best = found.join(t, "early").groupBy("late").agg(F.min(F.struct("place", "t", "early", "rule")).alias("b"))
    return best.select("late", F.col("b.early").alias("home"), "b.rule")
