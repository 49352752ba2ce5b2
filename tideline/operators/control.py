"""Who holds what, batch by batch: claims confirm, contradict or let lapse the stored state of a place.

A batch's claims are counted by place and side in one aggregation; the stored table meets the counts by a full outer join,
like MERGE. A row remembers the last batch that it has taken in, so a batch that is applied again changes nothing.

Claims have: place, side, whole (all of the place), outlet, camp (whose outlet it is; null: nobody's, it counts for itself),
wire (a wire is confirmation enough), at. State has: place, side, was (its holder before it was contested), since, batch.

Rules: a claim of the holder changes nothing. Others' claims make a place contested, or theirs if the whole of it is
claimed by one side with confirmation: outlets of two camps, or a wire. A contested place goes to the one side that has
confirmation of the whole; if two have, it stays contested. A contested place of which nothing is claimed for `lapse`
seconds goes back to its holder before. Places without a row are nobody's ("").

Defined results: claims without place or side count for nothing; repeated claims count once; an empty batch only lets
contested places lapse; a batch number at or below a row's own leaves that row as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTESTED = "contested"
STATE = "place string, side string, was string, since long, batch long"


def counted(claims: DataFrame) -> DataFrame:
    """(place, rivals): of each place its claims by side: {side, whole, confirmed, latest}, sides in order."""
    voice = F.coalesce(F.concat(F.lit("camp:"), "camp"), F.concat(F.lit("own:"), "outlet"))
    whole = F.coalesce("whole", F.lit(False))
    by_side = claims.filter("place is not null and side is not null").groupBy("place", "side").agg(
        F.max(whole).alias("whole"), (F.count_distinct(F.when(whole, voice)) >= 2).alias("two"), F.coalesce(F.max(whole & F.col("wire")), F.lit(False)).alias("wired"), F.max("at").alias("latest")
    )
    one = F.struct("side", "whole", (F.col("two") | F.col("wired")).alias("confirmed"), "latest")
    return by_side.groupBy("place").agg(F.array_sort(F.collect_list(one)).alias("claims"))  # a row a side


def apply_batch(state: DataFrame, claims: DataFrame, batch: int, now: int, *, lapse: int = 7 * 86400) -> DataFrame:
    """The state after a batch, with `changed`, whether this batch has changed its side."""
    both = state.select("place", "side", "was", "since", "batch").join(counted(claims), "place", "full_outer")
    side, none = F.coalesce("side", F.lit("")), F.array().cast("array<struct<side:string,whole:boolean,confirmed:boolean,latest:bigint>>")
    told = F.coalesce("claims", none)
    rivals = F.filter(told, lambda c: c["side"] != side)
    won = F.filter(rivals, lambda c: c["whole"] & c["confirmed"])
    lapsed = (side == CONTESTED) & (F.size(told) == 0) & (F.lit(now) - F.col("since") >= lapse)
    to = (
        F.when(lapsed, F.coalesce("was", F.lit(""))).when(F.size(rivals) == 0, side).when(F.size(won) == 1, won[0]["side"])
        .otherwise(F.lit(CONTESTED))
    )
    fresh = F.coalesce(F.col("batch") < batch, F.lit(True))
    new = F.when(fresh, to).otherwise(side)
    latest = F.array_max(F.transform(told, lambda c: c["latest"]))
    out = both.select("place", "side", "was", "since", "batch", side.alias("_old"), new.alias("_new"), latest.alias("_at"), fresh.alias("_fresh"))
    moved = F.col("_new") != F.col("_old")
    # A contested place that is fought over stays fresh: its time is that of the latest claim.
    since = F.when(moved, F.coalesce("_at", F.lit(now))).when(F.col("_fresh") & (F.col("_old") == CONTESTED) & F.col("_at").isNotNull(), F.greatest("since", "_at")).otherwise(F.col("since"))
    was = F.when(moved & (F.col("_new") == CONTESTED), F.col("_old")).otherwise(F.col("was"))
    return out.select("place", F.col("_new").alias("side"), was.alias("was"), since.alias("since"), F.when(F.col("_fresh"), F.lit(batch).cast("long")).otherwise(F.col("batch")).alias("batch"), moved.alias("changed"))
