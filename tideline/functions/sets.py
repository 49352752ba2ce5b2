"""Similarities of word sets held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, shared(a, b) / F.size(F.array_union(a, b))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, shared(a, b) / least).otherwise(0.0)


def contained(a: Column, b: Column) -> Column:
    """Share of a that b has."""
    return F.when(F.size(a) > 0, shared(a, b) / F.size(a)).otherwise(0.0)


def rank_weighted(keys: Column, words: Column) -> Column:
    """Sum of 1 / (1 + rank) over the keys that the words have."""
    return F.aggregate(
        F.transform(keys, lambda k, i: F.when(F.array_contains(words, k), 1.0 / (1 + i)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x
    )


def meets(a: Column, b: Column) -> Column:
    """Overlap where an empty side stands for anything."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)
