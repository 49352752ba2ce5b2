"""Similarity pairs by block and time and greedy folding of later reports into the first earlier home that matches.

The fold is order-dependent and not transitive: a report joins a home, never another copy, so components would merge too
much.  Homes are found in rounds over the pair table: a report all of whose earlier matches are decided becomes a home if
none of them is one, a copy otherwise.  The pairs are cut in time order into blocks of a bounded number of rows; a round
streams every block once, which settles whole chains inside it, and joins hand the results on to later blocks.  It goes on
until every report is decided.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.sets import overlap
from tideline.lineage import cut


def jaccard_pairs(items: DataFrame, *, key: str, block: list[str], at: str, words: str, least: float, within: int) -> DataFrame:
    """(early, late, similarity) of items of a block, within seconds of each other, whose word sets are that similar.

    Items meet by block and time bucket, each once or twice with its set, and a pair is judged where it meets: first by the
    sizes of its sets, which bound their likeness. (Keys for words would repeat an item, with its set, for most of its words.)"""
    sets = items.select(F.col(key).alias("k"), *block, F.col(at).alias("t"), F.array_compact(F.array_distinct(words)).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    late = sets.select(*block, F.col("k").alias("late"), F.col("t").alias("lt"), F.col("w").alias("wl"), F.col("n").alias("nl"), F.explode(F.sequence(F.floor((F.col("t") - within) / within), F.floor(F.col("t") / within))).alias("b"))
    early = sets.select(*block, F.col("k").alias("early"), F.col("t").alias("et"), F.col("w").alias("we"), F.col("n").alias("ne"), F.floor(F.col("t") / within).alias("b"))
    first = F.struct(F.col("et"), F.col("early")) < F.struct(F.col("lt"), F.col("late"))
    enough = F.least("ne", "nl") >= F.greatest("ne", "nl") * least - 1e-9
    both = late.join(early, [*block, "b"]).filter(first & (F.col("lt") - F.col("et") <= within) & enough)
    common = F.size(F.array_intersect("we", "wl"))
    similar = both.select("early", "late", (common / (F.col("ne") + F.col("nl") - common)).alias("similarity"))
    return similar.filter(F.col("similarity") >= least).distinct()


def _settle(batches):
    """(k, home) of the late reports of a task that can be decided; rows (early, late, home) of a late report stand together,
    those it depends on before it where the task has them."""
    known: dict = {}
    late, some, unsure = None, False, False

    def decided():
        if some or not unsure:
            known[late] = not some
            return [(late, not some)]
        return []

    for batch in batches:
        out = []
        for e, x, home in zip(*(batch.column(c).to_pylist() for c in ("early", "late", "home"))):
            if x != late:
                out += decided() if late is not None else []
                late, some, unsure = x, False, False
            home = known.get(e) if home is None else home
            some, unsure = some or bool(home), unsure or home is None
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.schema.field("late").type), pa.array([h for _, h in out], pa.bool_())], ["k", "home"])
        kind = batch.schema.field("late").type
    if late is not None:
        out = decided()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], kind), pa.array([h for _, h in out], pa.bool_())], ["k", "home"])


def greedy_homes(pairs: DataFrame, order: DataFrame | None = None, block_rows: int = 500_000) -> DataFrame:
    """(early, late): pairs of matching reports, early before late, of which each late report is a copy and early a home.

    order (k, at) says when reports come, otherwise they come by key. It only decides how many rounds it takes: a round
    settles at least the first block of `block_rows` pairs that is not settled."""
    pairs = pairs.select("early", "late").distinct()
    timed = pairs.join(order.select(F.col("k").alias("late"), "at"), "late", "left") if order is not None else pairs.withColumn("at", F.lit(0))
    pairs = cut(timed.select("early", "late", "at"))
    blocks = pairs.count() // block_rows + 1
    dealt = pairs.coalesce(1) if blocks == 1 else pairs.repartitionByRange(blocks, "at", "late")
    rows = cut(dealt.select("*", F.spark_partition_id().alias("block"), F.lit(None).cast("boolean").alias("home")))
    fresh = cut(pairs.select(F.col("early").alias("k")).distinct().join(pairs.select(F.col("late").alias("k")), "k", "left_anti").withColumn("home", F.lit(True)))
    state = [fresh]
    kind = f"k {pairs.schema['late'].dataType.simpleString()}, home boolean"
    while True:
        rows = rows.join(fresh.select(F.col("k").alias("late")), "late", "left_anti")
        rows = rows.join(fresh.toDF("early", "now"), "early", "left").withColumn("home", F.coalesce("home", "now")).drop("now")
        rows = cut(rows.select("early", "late", "at", "block", "home"))
        if rows.isEmpty():
            break
        dealt = rows.coalesce(1) if blocks == 1 else rows.repartition(blocks, "block")
        fresh = cut(dealt.sortWithinPartitions("block", "at", "late").select("early", "late", "home").mapInArrow(_settle, kind))
        if fresh.isEmpty():
            raise RuntimeError("reports depend on each other in a circle")
        state.append(fresh)
    settled = reduce(DataFrame.unionByName, state)
    homes = settled.filter("home").select(F.col("k").alias("early"))
    copies = settled.filter("not home").select(F.col("k").alias("late"))
    return pairs.select("early", "late").join(homes, "early", "left_semi").join(copies, "late", "left_semi").select("early", "late")


def first_homes(pairs: DataFrame, order: DataFrame, key: str, at: str) -> DataFrame:
    """(copy, home) with the earliest home by (time, key)."""
    o = order.select(F.col(key).alias("early"), F.col(at).alias("t"))
    homes = greedy_homes(pairs, o.toDF("k", "at"))
    return homes.join(o, "early").groupBy("late").agg(F.min(F.struct("t", "early")).alias("m")).select(F.col("late").alias("copy"), F.col("m.early").alias("home"))


def same_story(a: Column, b: Column, names_a: Column, names_b: Column) -> Column:
    return (overlap(a, b) >= 0.5) | ((F.size(F.array_intersect(names_a, names_b)) >= 3) & (overlap(a, b) >= 0.3))
