"""Queries of states that change batch by batch, one-to-one absorption, and cascades of attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.lineage import cut
from tideline.operators.cascade import Attempt, answer, best_of
from tideline.operators.clusters import OPEN, move_clusters
from tideline.operators.control import STATE, apply_batch
from tideline.operators.ordered_fold import absorb
from tideline.session import POSITIONS, positions, table

_START = 1704067200
#: Batches end on these days (seconds after the first of the year).
_BATCHES = [d * 86400 for d in (10, 20, 30)]
_LAPSE = 7 * 86400


def _control_sql() -> str:
    """Batch after batch as one more table, by the rules in SQL."""
    out = f"""{POSITIONS}, c AS (SELECT event_id, 'd' || CAST(key % 60 AS VARCHAR) AS place, ['a', 'b'][event_id % 2 + 1] AS side, event_id % 3 = 0 AS whole, event_id % 13 AS outlet, t FROM positions WHERE event_type = 'error' AND value > 60),
      s0 AS (SELECT 'd' || CAST(i AS VARCHAR) AS place, CASE WHEN i % 3 = 0 THEN 'contested' WHEN i % 3 = 1 THEN 'a' ELSE 'b' END AS side, CASE WHEN i % 3 = 0 THEN 'a' END AS was, CAST({_START} AS BIGINT) AS since, CAST(0 AS BIGINT) AS batch FROM range(40) r(i))"""
    for n, end in enumerate(_BATCHES, 1):
        begin = 0 if n == 1 else _BATCHES[n - 2]
        out += f""", g{n} AS (SELECT place, side, bool_or(whole) AS whole, count(DISTINCT CASE WHEN whole THEN CASE WHEN outlet % 4 = 3 THEN 'own' || outlet ELSE 'camp' || (outlet % 4) END END) >= 2 OR bool_or(whole AND outlet = 12) AS confirmed, max(t) AS latest
          FROM c WHERE t >= {_START + begin} AND t < {_START + end} GROUP BY 1, 2),
        m{n} AS (SELECT coalesce(s.place, g.place) AS place, coalesce(s.side, '') AS old, s.was, s.since, g.* EXCLUDE (place) FROM s{n - 1} s FULL JOIN
          (SELECT place, max(latest) AS latest, list({{'side': side, 'won': whole AND confirmed}}) AS l FROM g{n} GROUP BY place) g ON g.place = s.place),
        r{n} AS (SELECT *, len(list_filter(coalesce(l, []), lambda x: x.side <> old)) AS rivals, list_filter(coalesce(l, []), lambda x: x.side <> old AND x.won) AS won FROM m{n}),
        t{n} AS (SELECT *, CASE WHEN old = 'contested' AND l IS NULL AND {_START + end} - since >= {_LAPSE} THEN coalesce(was, '') WHEN rivals = 0 THEN old WHEN len(won) = 1 THEN won[1].side ELSE 'contested' END AS side FROM r{n}),
        s{n} AS (SELECT place, side, CASE WHEN side <> old AND side = 'contested' THEN old ELSE was END AS was,
          CASE WHEN side <> old THEN coalesce(latest, {_START + end}) WHEN old = 'contested' AND latest IS NOT NULL THEN greatest(since, latest) ELSE since END AS since, CAST({n} AS BIGINT) AS batch, side <> old AS changed FROM t{n})"""
    return f"WITH {out} SELECT place, side, was, since, batch, changed FROM s{len(_BATCHES)}"


def control_claims(spark, sf_dir):
    i = F.col("event_id")
    p = positions(spark, sf_dir).filter("event_type = 'error' and value > 60")
    outlet = i % 13
    return p.select(
        F.concat(F.lit("d"), F.col("key") % 60).alias("place"), F.when(i % 2 == 0, "a").otherwise("b").alias("side"), (i % 3 == 0).alias("whole"), outlet.cast("string").alias("outlet"),
        F.when(outlet % 4 != 3, (outlet % 4).cast("string")).alias("camp"), (outlet == 12).alias("wire"), F.col("t").alias("at"),
    )


def control_seed(spark):
    i = F.col("id")
    side = F.when(i % 3 == 0, "contested").when(i % 3 == 1, "a").otherwise("b")
    return spark.range(40).select(F.concat(F.lit("d"), i).alias("place"), side.alias("side"), F.when(i % 3 == 0, "a").alias("was"), F.lit(_START).cast("long").alias("since"), F.lit(0).cast("long").alias("batch"))


@query(224, 225, sql=_control_sql())
def control_live(spark, sf_dir):
    """Who holds what after three batches of claims."""
    state, claims = control_seed(spark), control_claims(spark, sf_dir)
    for n, end in enumerate(_BATCHES, 1):
        begin = 0 if n == 1 else _BATCHES[n - 2]
        some = claims.filter((F.col("at") >= _START + begin) & (F.col("at") < _START + end))
        state = cut(apply_batch(state.select(*(c.split()[0] for c in STATE.split(", "))), some, n, _START + end, lapse=_LAPSE))
    return state


@query(222)
def moving_fronts(spark, sf_dir):
    """Clusters of events after runs at the end of three stretches of four days, two days and a week apart."""
    p = positions(spark, sf_dir).select("lat", "lon", "t", (F.col("event_id") % 7).cast("string").alias("source"), "event_type")
    reports = p.select("lat", "lon", "t", "source", F.col("event_type").alias("name"))
    open_ = spark.createDataFrame([], OPEN)
    for day in (4, 6, 13):
        open_ = cut(move_clusters(open_, reports, _START + day * 86400, radius=120.0, window=4 * 86400))
    return open_


@query(248)
def tidied_ships(spark, sf_dir):
    """Incidents of a sea: unnamed ones of a day are one row, and each is absorbed by one named of its sea, a day either side."""
    e = positions(spark, sf_dir).select("event_id", (F.col("key") % 12).cast("string").alias("sea"), F.floor(F.col("t") / 86400).alias("day"), (F.col("event_id") % 5 == 0).alias("is_named"), "value")
    named = e.filter("is_named").select("sea", "day", "event_id", "is_named")
    unnamed = e.filter("not is_named").groupBy("sea", "day").agg(F.min(F.struct((-F.col("value")).alias("v"), "event_id")).alias("m")).select("sea", "day", "m.event_id", F.lit(False).alias("is_named"))
    found = absorb(named.unionByName(unnamed).withColumnRenamed("event_id", "id"), "sea")
    return found.withColumnRenamed("id", "event_id").select("event_id", "sea", "day", "is_named", "partner")


_KEYS = [("copy", "md5(text)"), ("title", "nullif(trim(lower(split_part(text, chr(10), 1))), '')"), ("ending", "nullif(trim(lower(split_part(text, chr(10), -1))), '')"), ("source and beginning", "source || left(text, 3)")]


@query(397, 398, 407, sql=f"""WITH k AS (SELECT doc_id, {", ".join(f"{sql} AS k{n}" for n, (_, sql) in enumerate(_KEYS))} FROM documents),
{", ".join(f"c{n} AS (SELECT k{n}, min(doc_id) AS a{n} FROM k WHERE k{n} IS NOT NULL GROUP BY 1)" for n in range(len(_KEYS)))},
j AS (SELECT k.*, {", ".join(f"CASE WHEN a{n} < doc_id THEN a{n} END AS f{n}" for n in range(len(_KEYS)))} FROM k {" ".join(f"LEFT JOIN c{n} USING (k{n})" for n in range(len(_KEYS)))})
SELECT doc_id, coalesce({", ".join(f"f{n}" for n in range(len(_KEYS)))}) AS answer, CASE {" ".join(f"WHEN f{n} IS NOT NULL THEN '{name}'" for n, (name, _) in enumerate(_KEYS))} END AS answered_by,
  CASE {" ".join(f"WHEN f{n} IS NOT NULL THEN " + " + ".join(f"CASE WHEN k{m} IS NULL THEN 0 ELSE 1 END" for m in range(n + 1)) for n in range(len(_KEYS)))} ELSE {" + ".join(f"CASE WHEN k{m} IS NULL THEN 0 ELSE 1 END" for m in range(len(_KEYS)))} END AS tried FROM j""")
def traced_origins(spark, sf_dir):
    """The earliest document that another may come from: a copy, else its title, its ending, or its source and beginning."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    line = lambda n: F.nullif(F.trim(F.lower(F.split_part("text", F.lit("\n"), F.lit(n)))), F.lit(""))
    keys = {"copy": F.md5("text"), "title": line(1), "ending": line(-1), "source and beginning": F.concat("source", F.left("text", F.lit(3)))}
    attempts = [Attempt(name, k, best_of(d, k, "doc_id"), F.col("candidate") < F.col("doc_id")) for name, k in keys.items()]
    return answer(d, "doc_id", attempts).select("doc_id", "answer", "answered_by", "tried")
