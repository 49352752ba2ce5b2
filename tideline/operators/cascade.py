"""Ordered attempts to answer rows, each made only for the rows that earlier ones have left.

An attempt is a key of the row and a table of candidates by that key. Attempts are left joins in one plan, one after the
other; a row that is answered goes on under a key of its own that nothing has, so it is neither tried again nor gathered
with the other answered rows in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Attempt:
    """name: what is recorded of an answer; key: of the row (null: not tried); candidates: (key, answer), of which each row
    may take the least answer that fits."""

    name: str
    key: Column
    candidates: DataFrame
    fits: Column | None = None


def answer(rows: DataFrame, row_key: str, attempts: list[Attempt]) -> DataFrame:
    """rows with answer, answered_by (the attempt's name) and tried (how many attempts were made for the row).

    candidates have one row a key at most (best of a key first, by best_of); `fits` may name the columns of the row and
    `candidate`. Rows that no attempt answers have nulls and the number of attempts that had a key."""
    out = rows.withColumns({"answer": F.lit(None), "answered_by": F.lit(None).cast("string"), "tried": F.lit(0)})
    for n, a in enumerate(attempts):
        kind = a.candidates.schema["answer"].dataType
        open_ = F.col("answer").isNull() & a.key.isNotNull()
        own = F.when(open_, F.concat(F.lit("k:"), a.key.cast("string"))).otherwise(F.concat(F.lit("-:"), F.coalesce(F.col(row_key).cast("string"), F.lit(""))))
        known = a.candidates.select(F.concat(F.lit("k:"), F.col("key").cast("string")).alias("_k"), F.col("answer").alias("candidate"))
        out = out.withColumns({"_own": own, "_open": open_}).join(known, F.col("_own") == F.col("_k"), "left")
        hit = F.col("_open") & F.col("candidate").isNotNull() & (a.fits if a.fits is not None else F.lit(True))
        out = out.withColumns({
            "answer": F.when(hit, F.col("candidate")).otherwise(F.col("answer").cast(kind)), "answered_by": F.when(hit, a.name).otherwise(F.col("answered_by")),
            "tried": F.col("tried") + F.col("_open").cast("int"),
        }).drop("_own", "_open", "_k", "candidate")
    return out


def best_of(rows: DataFrame, key: Column, answer_: str) -> DataFrame:
    """(key, answer): the least answer of each key."""
    return rows.select(key.alias("key"), F.col(answer_).alias("answer")).filter("key is not null").groupBy("key").agg(F.min("answer").alias("answer"))
