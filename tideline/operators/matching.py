"""Matching names: longest prefixes by length as a key, and tiers of ever looser matches, as equi-joins only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bare(c: Column) -> Column:
    """Upper case, with one blank for every stretch of anything but letters A-Z and digits."""
    return F.trim(F.regexp_replace(F.upper(c), r"[^A-Z0-9]+", " "))


def longest_prefix(rows: DataFrame, col: str, table: DataFrame, prefix: str) -> DataFrame:
    """rows with the columns of the table's row whose prefix is the longest that `col` begins with; nulls where none is.

    Every value meets the table once for each length that prefixes have (few: the lengths are collected), by an equi-join on
    the cut value. Values are made distinct first, so a value that very many rows have meets it once. Null and empty prefixes
    match nothing; of equal prefixes the row with the least other columns counts."""
    others = [c for c in table.columns if c != prefix]
    known = table.filter(F.length(prefix) > 0).groupBy(F.col(prefix).alias("_p")).agg(F.min(F.struct(*others)).alias("_r"))
    lengths = sorted(r["n"] for r in known.select(F.length("_p").alias("n")).distinct().collect())
    cuts = F.array(*(F.when(F.length("_v") >= n, F.left("_v", F.lit(n))) for n in lengths)) if lengths else F.array().cast("array<string>")
    values = rows.select(F.col(col).cast("string").alias("_v")).distinct().select("_v", F.explode(F.array_compact(cuts)).alias("_p"))
    best = values.join(known, "_p").groupBy("_v").agg(F.max_by(F.struct("_p", "_r"), F.length("_p")).alias("_m"))
    out = rows.join(best, F.col(col).cast("string") == F.col("_v"), "left")
    return out.select(*rows.columns, F.col("_m._p").alias(prefix), *(F.col(f"_m._r.{c}").alias(c) for c in others))


def ranked_prefix(rows: DataFrame, col: str, keys: list[str], table: DataFrame, name: str, rank: str, least: int = 4) -> DataFrame:
    """rows with the least rank of the table's names that `col` is, begins with as whole words, or begins with at all if the
    name has `least` characters; names and values are compared in bare form, within equal keys."""
    v = rows.select(*keys, col).distinct().withColumn("_v", bare(F.col(col)))
    known = table.select(*keys, bare(F.col(name)).alias("_p"), rank).filter(F.length("_p") >= 2)
    lengths = sorted(r["n"] for r in known.select(F.length("_p").alias("n")).distinct().collect())
    cut = [F.when((F.length("_v") == n) | (F.substr("_v", F.lit(n + 1), F.lit(1)) == " ") | (F.lit(n >= least) & (F.length("_v") > n)), F.left("_v", F.lit(n))) for n in lengths]
    cuts = F.array_compact(F.array(*cut)) if cut else F.array().cast("array<string>")
    best = v.select(*keys, col, F.explode(cuts).alias("_p")).join(known, [*keys, "_p"]).groupBy(*keys, col).agg(F.min(rank).alias(rank))
    return rows.join(best, [*keys, col], "left")


_TAIL = r"^.*(?:>|=|\bTO\b)"


def tiered_match(rows: DataFrame, col: str, names: DataFrame, *, place: str = "place", alias: str = "alias", code: str = "code", compact: int = 5) -> DataFrame:
    """rows with the place that a free text names, and the tier that found it: 0 a code in the text (the last), then for the
    part after the last ">", "=" or "TO" and then for the whole: 1 the alias itself, 2 it begins with it, 3 ends with it, 4
    holds it, all by whole words (5 to 8 for the whole), and last 9: it holds the alias without blanks, of `compact`
    characters at least. Within a tier the longer alias counts, then the lesser place.

    names: (place, alias, code), a row an alias. Texts are made distinct; their runs of as many words as aliases have meet
    the aliases by an equi-join, their pieces of `compact` characters the beginnings of aliases. Null and blank texts and
    texts that nothing matches have nulls."""
    texts = rows.select(F.col(col).alias("_t")).filter(F.col("_t").isNotNull()).distinct().withColumn("_d", bare(F.col("_t")))
    whole, tail = F.split("_d", " "), F.split(bare(F.regexp_replace(F.upper("_t"), _TAIL, "")), " ")
    known = names.select(F.col(place).alias("_place"), bare(F.col(alias)).alias("_a")).filter(F.col("_a") != "").groupBy("_a").agg(F.min("_place").alias("_place"))
    most = known.agg(F.max(F.size(F.split("_a", " ")))).first()[0] or 0
    sides = F.array(F.struct(F.lit(0).alias("late"), tail.alias("w")), F.struct(F.lit(4).alias("late"), whole.alias("w")))
    words = texts.select("_t", F.explode(sides).alias("s")).select("_t", "s.late", "s.w", F.size("s.w").alias("n")).filter("w[0] <> ''")
    at = words.select("_t", "late", "w", "n", F.posexplode("w").alias("i", "_"))
    run_lengths = F.sequence(F.lit(1), F.least(F.lit(max(most, 1)), F.col("n") - F.col("i")))
    runs = at.select("_t", "late", "n", "i", F.explode(F.transform(run_lengths, lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.col("i") + 1, k), " ").alias("a")))).alias("r"))
    first, end = F.col("i") == 0, F.col("i") + F.col("r.k") == F.col("n")
    tier = F.when(first & end, 1).when(first, 2).when(end, 3).otherwise(4) + F.col("late")
    found = [runs.join(known, F.col("r.a") == F.col("_a")).select("_t", tier.alias("tier"), (-F.length("_a")).alias("less"), F.col("_place"))]
    codes = names.select(F.col(place).alias("_place"), F.upper(code).alias("_a")).filter("_a is not null").groupBy("_a").agg(F.min("_place").alias("_place"))
    told = F.transform(F.regexp_extract_all("_d", F.lit(r"\b([A-Z]{2} ?[A-Z0-9]{3})\b"), F.lit(1)), lambda x: F.replace(x, F.lit(" "), F.lit("")))
    met = texts.select("_t", F.posexplode(told).alias("i", "_a")).join(codes, "_a")
    found.append(met.select("_t", F.lit(0).alias("tier"), (-F.col("i")).alias("less"), "_place"))
    pieces = texts.withColumn("_c", F.replace(F.col("_d"), F.lit(" "), F.lit(""))).filter(F.length("_c") >= compact)
    pieces = pieces.select("_t", "_c", F.explode(F.sequence(F.lit(1), F.length("_c") - compact + 1)).alias("i")).withColumn("_k", F.substr("_c", F.col("i"), F.lit(compact)))
    close = known.withColumn("_c2", F.replace(F.col("_a"), F.lit(" "), F.lit(""))).filter(F.length("_a") >= compact).withColumn("_k", F.left("_c2", F.lit(compact)))
    held = pieces.join(close, "_k").filter(F.substr("_c", F.col("i"), F.length("_c2")) == F.col("_c2"))
    found.append(held.select("_t", F.lit(9).alias("tier"), (-F.length("_a")).alias("less"), "_place"))
    best = reduce(DataFrame.unionByName, found).groupBy("_t").agg(F.min(F.struct("tier", "less", "_place")).alias("_m"))
    return rows.join(best, F.col(col) == F.col("_t"), "left").select(*rows.columns, F.col("_m._place").alias(place), F.col("_m.tier").alias("tier"))
