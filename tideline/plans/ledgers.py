"""Queries of running figures, ledgers and merged cards: folds in order, with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import text
from tideline.operators.merging import merge_cards, merge_groups, merge_pins
from tideline.operators.ordered_fold import incident_ledger, running_figures
from tideline.session import positions, reports, table

_VALUE = "CAST(floor(o_totalprice / CASE o_orderkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 100 WHEN 2 THEN 10 ELSE 1 END) AS BIGINT)"


def _guarded_sql(keys: str, unofficial: bool) -> str:
    """The fold as a recursive query: one row of a key after another."""
    counts = "TRUE" if unofficial else "u.official"
    corrected = "FALSE" if unofficial else "NOT w.official"
    by = ", ".join(keys.split())
    on = " AND ".join(f"u.{k} = w.{k}" for k in keys.split())
    return f"""WITH RECURSIVE u AS (
  SELECT o_orderkey, o_orderdate, o_custkey % 25 AS field, o_orderstatus AS side, {_VALUE} AS value, 'b' || CAST(o_custkey % 7 AS VARCHAR) AS issuer,
    o_custkey % 7 <> 6 AS official, o_orderkey % 9 <> 4 AS stated FROM orders
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY o_orderdate, o_orderkey) AS n FROM u
), walk AS (
  SELECT DISTINCT {by}, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS o_orderkey, FALSE AS accepted, CAST(NULL AS BIGINT) AS standing, CAST(NULL AS VARCHAR) AS standing_issuer, FALSE AS official FROM u
  UNION ALL
  SELECT {", ".join("t." + k for k in keys.split())}, t.n, t.o_orderkey, ok, CASE WHEN ok THEN value ELSE standing END, CASE WHEN ok THEN issuer ELSE standing_issuer END, CASE WHEN ok THEN t.own ELSE t.was END
  FROM (SELECT {", ".join("u." + k for k in keys.split())}, u.n, u.o_orderkey, u.value, u.issuer, u.official AS own, w.official AS was, w.standing, w.standing_issuer,
      u.stated AND {counts} AND (w.standing IS NULL OR ((u.value >= w.standing OR u.issuer = w.standing_issuer OR {corrected}) AND NOT (w.standing > 50 AND u.value > 10 * w.standing))) AS ok
    FROM walk w JOIN numbered u ON {on} AND u.n = w.n + 1) t
)
SELECT o_orderkey, {by}, accepted, standing, standing_issuer FROM walk WHERE n > 0"""


def _updates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_orderdate", (F.col("o_custkey") % 25).alias("field"), F.col("o_orderstatus").alias("side"), F.expr(_VALUE).alias("value"),
        F.concat(F.lit("b"), F.col("o_custkey") % 7).alias("issuer"), (F.col("o_custkey") % 7 != 6).alias("official"), (F.col("o_orderkey") % 9 != 4).alias("stated"),
    )


@query(241, sql=_guarded_sql("field", False))
def guarded_figures(spark, sf_dir):
    """Orders as updates of 25 running figures: official ones only, falls by the issuer only, no tenfold jumps."""
    found = running_figures(_updates(spark, sf_dir), ["field"], ["o_orderdate", "o_orderkey"])
    return found.select("o_orderkey", "field", "accepted", "standing", "standing_issuer")


@query(242, sql=_guarded_sql("field side", True))
def side_figures(spark, sf_dir):
    """The same for each side's own claims, which no official body has to confirm."""
    found = running_figures(_updates(spark, sf_dir), ["field", "side"], ["o_orderdate", "o_orderkey"], unofficial_count=True)
    return found.select("o_orderkey", "field", "side", "accepted", "standing", "standing_issuer")


_HARM = "CASE event_id % 7 WHEN 0 THEN 'suspicious approach' WHEN 1 THEN 'near miss' WHEN 2 THEN 'hit' WHEN 3 THEN 'sunk' ELSE 'attacked' END"


@query(243, sql=f"""WITH RECURSIVE r AS (
  SELECT event_id, user_id, CAST(ts AS DATE) - DATE '1970-01-01' AS day, {_HARM} AS harm, event_id % 4 AS rank, 's' || CAST(event_id % 9 AS VARCHAR) AS source,
    CASE WHEN event_id % 3 = 0 THEN 'f' || CAST(event_id % 5 AS VARCHAR) END AS flag, CASE WHEN event_id % 5 = 0 THEN 'w' || CAST(event_id % 4 AS VARCHAR) END AS weapon,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 2 END AS worse
  FROM events
), walk AS (
  SELECT event_id, user_id, n, CAST(1 AS BIGINT) AS incident, TRUE AS opens, day, harm, worse, rank, source, flag, weapon FROM r WHERE n = 1
  UNION ALL
  SELECT r.event_id, r.user_id, r.n, CASE WHEN abs(r.day - w.day) > 1 THEN w.incident + 1 ELSE w.incident END, abs(r.day - w.day) > 1,
    CASE WHEN abs(r.day - w.day) > 1 THEN r.day ELSE w.day END,
    CASE WHEN abs(r.day - w.day) > 1 OR (r.worse > 1 AND r.worse > w.worse) THEN r.harm ELSE w.harm END,
    CASE WHEN abs(r.day - w.day) > 1 OR (r.worse > 1 AND r.worse > w.worse) THEN r.worse ELSE w.worse END,
    CASE WHEN abs(r.day - w.day) > 1 OR r.rank > w.rank THEN r.rank ELSE w.rank END, CASE WHEN abs(r.day - w.day) > 1 OR r.rank > w.rank THEN r.source ELSE w.source END,
    CASE WHEN abs(r.day - w.day) > 1 THEN r.flag ELSE coalesce(w.flag, r.flag) END, CASE WHEN abs(r.day - w.day) > 1 THEN r.weapon ELSE coalesce(w.weapon, r.weapon) END
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1
)
SELECT event_id, user_id, incident, opens, harm AS harm_now, source AS source_now, flag AS flag_now, weapon AS weapon_now FROM walk""")
def ledger(spark, sf_dir):
    """Events as reports of incidents: joined within a day, worse harm and better sources win, facts are filled."""
    e = table(spark, sf_dir, "events")
    found = e.select(
        "event_id", "user_id", "ts", F.unix_date(F.to_date("ts")).alias("day"), F.expr(_HARM).alias("harm"), (F.col("event_id") % 4).alias("rank"), F.concat(F.lit("s"), F.col("event_id") % 9).alias("source"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("f"), F.col("event_id") % 5)).alias("flag"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("w"), F.col("event_id") % 4)).alias("weapon"),
    )
    return incident_ledger(found, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "incident", "opens", "harm_now", "source_now", "flag_now", "weapon_now")


SEAS = ("north", "strait", "south", "ocean")
NEIGHBOURS = frozenset({("north", "strait"), ("strait", "south")})


def cards(spark, sf_dir):
    """Documents as cards of incidents: what is told comes of the first line, so equal lines tell the same."""
    r = reports(spark, sf_dir).withColumn("h", F.crc32("summary"))
    pick = lambda k, words, n: F.element_at(F.array(*(F.lit(w) for w in words)), (F.floor(F.col("h") / k) % n + 1).cast("int"))
    return r.select(
        F.col("doc_id").alias("id"), "desk", F.col("at").alias("t"), "source", (F.crc32("source") % 3).alias("rank"), pick(1, ("ship", "tanker", "carrier"), 3).alias("kind"),
        pick(3, (*SEAS, None), 5).alias("sea"), F.when(F.floor(F.col("h") / 15) % 3 == 0, F.concat(F.lit("mv"), F.floor(F.col("h") / 45) % 23)).alias("name"), pick(1035, ("mine", "drone", None), 3).alias("cause"),
    )


@query(189, 409, 410)
def merged_cards(spark, sf_dir):
    """Cards folded into homes that change as copies join."""
    return merge_cards(cards(spark, sf_dir), ["desk"], within=12 * 3600, neighbours=NEIGHBOURS).withColumnRenamed("id", "doc_id").select("doc_id", "home", "joined", "lead", "also", "kind_now", "sea_now", "name_now", "cause_now")


@query(422)
def merged_pins(spark, sf_dir):
    """Events as pins of places: one pin an event told several times, with its best row in the lead."""
    i = F.col("event_id")
    p = positions(spark, sf_dir).select(
        i.alias("id"), F.concat(F.lit("Place "), F.col("key") % 40).alias("name"), F.floor(F.col("t") / 86400).alias("day"), F.when(i % 4 != 0, F.col("t")).alias("t"),
        (F.col("key") % 40 + i % 7 * 0.03).alias("lat"), (F.col("key") % 40 * 2.0 + i % 5 * 0.02).alias("lon"), F.concat(F.lit("u"), i % 9).alias("link"), F.concat(F.lit("s"), i % 6).alias("source"), F.when(i % 3 == 0, F.concat(F.lit("a"), i % 2)).alias("actor"),
    )
    return merge_pins(p, "name").withColumnRenamed("id", "event_id").select("event_id", "pin", "joined", "lead", "also", "actor_now", "score_now")


@query(293, sql=r"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(summary), '[^\p{L}\p{Nd}]+'), lambda x: length(x) >= 7))) AS term FROM (SELECT doc_id, split_part(text, chr(10), 1) AS summary FROM documents)),
v AS (SELECT DISTINCT left(term, 5) || right(term, 1) AS id, term FROM w), m AS (SELECT DISTINCT w.doc_id, v.id FROM w JOIN v USING (term))
SELECT doc_id, term FROM w UNION SELECT doc_id, v.term FROM m JOIN v USING (id)""")
def widened_ideas(spark, sf_dir):
    """Words of a headline with all words that are grouped with one of them: same beginning, same end."""
    w = reports(spark, sf_dir).select(F.col("doc_id").alias("id"), F.explode(F.filter(text.words(F.col("summary")), lambda x: F.length(x) >= 7)).alias("term"))
    groups = w.select(F.concat(F.left("term", F.lit(5)), F.right("term", F.lit(1))).alias("id"), "term")
    return merge_groups(w, groups).withColumnRenamed("id", "doc_id")
