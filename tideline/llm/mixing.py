"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in shuffled order, which starts over at its end, up to `most_repeats` times.  The
virtual finish time of a copy is what its source has served by the copy's end over the source's target.  The copies of all
sources are served in the order of virtual finish time until their running total reaches the budget, the sum of all sizes:
the mix is cut there, and the copy that the cut falls into is taken in part.  At virtual time 1 every source has served
its target but for the copy it has not finished, so a source's words come within a document of its target.

Nothing gathers a source or the mix: the shuffle key deals a source's documents into blocks, and a document's place in its
queue is its block's start plus its place in the block.  Virtual time deals the copies into stretches; stretches are summed
where the copies are, all stretches before the one with the cut are taken whole, and only that one is sorted by finish time.
The result is sorted by range of virtual finish time.

Targets: source k by code point (null last) has weight `weights[k mod len]`; targets share the sum of all sizes by
weight, stop at most_repeats times their source's size, and pass the excess on by weight until none is above.

Defined results: a null or blank text has size 0 and nothing of it is taken, where all are blank the mix is empty; a null source is a source of its own; rows
that repeat an id are documents of their own (order: hash of id and text, so rows of one id or without an id are dealt out
like all others); an empty table gives no rows; other columns pass through, and ones named like the added columns are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.scratch import Scratch

ADDED = ("size", "source_size", "target", "taken", "virtual_finish")
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_repeats: int = 3) -> DataFrame:
    """sizes (queue, source_size) with the target of each queue. One row per source: windows over all of it are small."""
    by_name = Window.orderBy("queue")
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w.cast("long")).withColumn("most", F.col("source_size") * most_repeats)
    # In order of most / weight, those that reach their most come first; all in whole numbers.
    rows = rows.withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", "queue")
    sofar, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("most").over(sofar), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(sofar), F.lit(0)))
        .withColumn("full", F.col("most") * F.col("weights") <= F.col("weight") * F.col("rest"))
        .withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0)))
        .withColumn("sharing", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
    )
    level = (F.col("total") - F.col("spent")).cast("double") / F.col("sharing").cast("double")
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight").cast("double") * level)
    return rows.select("queue", "source_size", target.alias("target"))


def mix(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (5, 2, 1),
    most_repeats: int = 3, block_rows: int = 5_000, seed: str = "mix", keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` (all by default) with size, source_size, target, taken (words) and virtual_finish (of the first
    copy), in order of virtual finish time."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    source, text, scratch = F.col(f"`{source_col}`").cast("string"), F.col(f"`{text_col}`"), Scratch(spark, "mixing")
    blocks = max(1, -(-docs.count() // block_rows))
    own = F.concat_ws(":", F.lit(seed), F.col(f"`{id_col}`").cast("string"), F.md5(text))
    rows = scratch.put(
        docs.select(
            *(F.col(f"`{c}`") for c in names),
            F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")).alias("_queue"),
            words(text).alias("size"), F.md5(own).alias("_key"),
        ).withColumn("_block", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * blocks / (1 << 32)).cast("int"))
    )
    order = Window.partitionBy("_queue", "_block").orderBy("_key", "size")
    before = Window.partitionBy("_queue").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("_queue", "_block").agg(F.sum("size").alias("block_size"))
    starts = sums.withColumn("_start", F.sum("block_size").over(before) - F.col("block_size")).select("_queue", "_block", "_start")
    goal = scratch.put(targets(sums.groupBy(F.col("_queue").alias("queue")).agg(F.sum("block_size").alias("source_size")), weights, most_repeats))
    placed = (
        rows.withColumn("_n", F.row_number().over(order))
        .withColumn("_inside", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        .join(starts, ["_queue", "_block"]).join(goal.withColumnRenamed("queue", "_queue"), "_queue")
        .withColumn("_from", F.col("_start") + F.col("_inside")).drop("_start", "_inside")
    )
    placed = scratch.put(placed)
    copy = F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))).alias("copy")
    own = ["_queue", "_block", "_n", "_key"]
    copies = placed.filter("size > 0").select(*own, "size", "target", "_from", "source_size", copy)
    finish = (F.col("_from") + F.col("source_size") * F.col("copy") + F.col("size")) / F.col("target")
    copies = copies.select(*own, "copy", "size", finish.alias("finish"), F.floor(finish * blocks).alias("stretch"))
    # A row a stretch, then one row: the first stretch in which the running total reaches the budget, and what is left for it.
    budget = sums.agg(F.coalesce(F.sum("block_size"), F.lit(0)).alias("budget"))
    sofar = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    served = copies.groupBy("stretch").agg(F.sum("size").alias("w")).withColumn("upto", F.sum("w").over(sofar)).crossJoin(F.broadcast(budget))
    cut = scratch.put(served.filter("upto >= budget").agg(F.min(F.struct("stretch", (F.col("budget") - (F.col("upto") - F.col("w"))).alias("left"))).alias("m")).select("m.stretch", "m.left"))
    in_order = Window.partitionBy("stretch").orderBy("finish", "_queue", "_key", "_n", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = copies.join(F.broadcast(cut), "stretch").withColumn("upto", F.sum("size").over(in_order))
    last = last.select("_queue", "_block", "_n", F.greatest(F.lit(0), F.least("size", F.col("left") - (F.col("upto") - F.col("size")))).alias("w"))
    last = last.groupBy("_queue", "_block", "_n").agg(F.sum("w").alias("_last"))  # as many documents as a stretch has
    begun = F.transform(F.sequence(F.lit(0), F.lit(most_repeats - 1)), lambda c: F.floor((F.col("_from") + F.col("source_size") * c + F.col("size")) / F.col("target") * blocks))
    whole = F.size(F.filter(begun, lambda x: x < F.col("_cut"))) * F.col("size")
    out = placed.crossJoin(F.broadcast(cut.select(F.col("stretch").alias("_cut")))).join(last, ["_queue", "_block", "_n"], "left")
    return out.select(
        *(F.col(f"`{c}`") for c in names), "size", "source_size", "target", F.coalesce(F.when(F.col("size") > 0, whole) + F.coalesce("_last", F.lit(0)), F.lit(0)).cast("long").alias("taken"),
        F.when(F.col("target") > 0, (F.col("_from") + F.col("size")) / F.col("target")).alias("virtual_finish"),
    ).sort("virtual_finish", F.col(f"`{id_col}`"))
