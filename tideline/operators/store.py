"""Store semantics over DataFrames: merge, tombstones, latest state, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, *, desk: str, before: int | None = None, since: int | None = None, limit: int = 400) -> DataFrame:
    """Keyset page: newest first, ties by key; Spark keeps the top rows of each partition only."""
    out = rows.filter(F.col("desk") == desk)
    if before is not None:
        out = out.filter(F.col("at") < before)
    if since is not None:
        out = out.filter(F.col("at") >= since)
    return out.orderBy(F.desc("at"), "fp").limit(limit)


def merge(base: DataFrame, fresh: DataFrame, tombstones: DataFrame, *, key: str, replace=(), unite=(), least=(), fill=()) -> DataFrame:
    """Upsert: `replace` takes the fresh value, `unite` the union of arrays, `least` the smaller, `fill` the old value if
    there is one; keys with a tombstone neither stay nor come back. Fresh rows have one row a key."""
    f = fresh.select(key, *(F.col(c).alias(f"_{c}") for c in fresh.columns if c != key))
    out = base.join(f, key, "full_outer").join(tombstones.select(key).distinct(), key, "left_anti")
    pick = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in replace} | {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in fill} | {c: F.least(c, f"_{c}") for c in least}
    pick |= {c: F.array_union(F.coalesce(F.col(c), F.array().cast("array<string>")), F.coalesce(F.col(f"_{c}"), F.array().cast("array<string>"))) for c in unite}
    return out.select(key, *(pick[c].alias(c) for c in base.columns if c != key))


def with_archive(stored: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and the archive rows that no key of theirs finds among them."""
    for k in keys:
        archive = archive.join(stored.select(k).distinct(), k, "left_anti")
    return stored.unionByName(archive)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one aggregate with map-side combine."""
    rest = [c for c in rows.columns if c not in [*keys, *order]]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in [*order, *rest]))


def checked_parents(children: DataFrame, rows: DataFrame) -> DataFrame:
    p = rows.select("conv_id", F.col("turn").alias("parent"), F.col("role").alias("_role"))
    out = children.join(p, ["conv_id", "parent"], "left")
    return out.select("conv_id", "turn", F.when(F.col("_role") != F.col("role"), F.col("parent")).alias("reply_to"))
