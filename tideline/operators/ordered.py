"""Ordered analytics: sessions, islands, running maxima, thinning, monotone folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(rows: DataFrame, keys: list[str], at: str, gap: int, tie: str) -> DataFrame:
    """rows with session: a number that rises when more than `gap` seconds passed since the key's last row."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def islands(rows: DataFrame, keys: list[str], at: str, tie: str, inside: Column) -> DataFrame:
    """Rows of runs in which a condition holds, with the number of the run."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    marked = rows.withColumn("_in", inside)
    start = F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0)
    return marked.withColumn("_s", start).withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("_in").drop("_in", "_s")


def rising(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Rows that are no lower than all before them."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_m", F.max(value).over(w)).filter(F.col(value) >= F.col("_m")).drop("_m")


def trailing_mean(rows: DataFrame, keys: list[str], at: str, value: str, n: int, name: str) -> DataFrame:
    """Mean of the last n rows, null before there are n."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(1 - n, Window.currentRow)
    return rows.withColumn(name, F.when(F.count(value).over(w) == n, F.avg(value).over(w)))


def thinned(rows: DataFrame, keys: list[str], at: str, tie: str, least_gap: int, most: int) -> DataFrame:
    """Rows at least least_gap seconds after the row before, then evenly thinned to at most `most` a key, the last kept."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    near = rows.withColumn("_g", F.col(at) - F.lag(at).over(w)).filter(F.col("_g").isNull() | (F.col("_g") >= least_gap)).drop("_g")
    counted = near.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys))})
    slot = F.floor((F.col("_i") * most - 1) / F.col("_n"))
    counted = counted.withColumn("_slot", slot).withColumn("_next", F.lead("_slot").over(w))
    return counted.filter((F.col("_n") <= most) | F.col("_next").isNull() | (F.col("_next") != F.col("_slot"))).drop("_i", "_n", "_slot", "_next")


def previous_greater(series: DataFrame, keys: list[str], at: str, value: str, width: int) -> DataFrame:
    """series with `since`, the last earlier time at which the value was greater (null if there was none).

    Time is cut into blocks of `width`. A row looks among the earlier rows of its own block, else for the last earlier block
    whose maximum is greater, and then only into that one. So what comes together is a block, or a key's maxima by block: a
    width near the square root of a key's times keeps both small. Null values and times have no answer and are none."""
    known = series.filter(F.col(at).isNotNull() & F.col(value).isNotNull())
    blocks = known.groupBy(*keys, F.floor(F.col(at) / width).alias("_b")).agg(F.collect_list(F.struct(F.col(at).alias("t"), F.col(value).alias("v"))).alias("_l"), F.max(value).alias("_m"))
    maxima = blocks.groupBy(*keys).agg(F.collect_list(F.struct("_b", "_m")).alias("_ms"))
    last = lambda l_, fits: F.array_max(F.transform(F.filter(l_, fits), lambda p: p["t"]))
    here = series.withColumn("_b", F.floor(F.col(at) / width)).join(blocks.drop("_m"), [*keys, "_b"], "left")
    here = here.withColumn("_near", last("_l", lambda p: (p["t"] < F.col(at)) & (p["v"] > F.col(value)))).drop("_l").join(maxima, keys, "left")
    far = F.array_max(F.transform(F.filter("_ms", lambda m: (m["_b"] < F.col("_b")) & (m["_m"] > F.col(value))), lambda m: m["_b"]))
    asked = here.withColumn("_b", F.when(F.col("_near").isNull(), far)).drop("_ms")
    out = asked.join(blocks.drop("_m"), [*keys, "_b"], "left")
    return out.select(*series.columns, F.coalesce("_near", last("_l", lambda p: p["v"] > F.col(value))).alias("since"))


def numbered(rows: DataFrame, keys: list[str], at: str, ties: list[str], name: str, *, width: int, falling: bool = False) -> DataFrame:
    """rows with their number (from 1) among those of their keys, by a whole-number column and then the ties.

    A key's rows are numbered by stretches of `width` of that column: a row's number is its place in its stretch plus the rows
    of the stretches before, so a key that very many rows have is no single sort. Nulls come first (last if falling); rows
    that are equal in all of it are numbered in any order."""
    first = F.desc_nulls_last if falling else F.asc_nulls_first
    cut = rows.withColumn("_b", F.floor(F.col(at) / width))
    inside = Window.partitionBy(*keys, "_b").orderBy(first(at), *ties)
    before = Window.partitionBy(*keys).orderBy(first("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    starts = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_m")).withColumn("_start", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_b")]
    out = cut.withColumn("_i", F.row_number().over(inside)).alias("l").join(starts.alias("r"), same)
    return out.select(*(F.col(f"l.{c}") for c in rows.columns), (F.col("_start") + F.col("_i")).cast("long").alias(name))
