"""Threads, follow-ups, sessions and waves: ordered relations between reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.operators import joins, ordered
from tideline.session import POSITIONS, REPORTS, positions, reports, table


@query(107, 108, 110, sql=f"""WITH {POSITIONS}, l AS (SELECT event_id, t, lag(event_id) OVER w AS p, lag(t) OVER w AS pt FROM positions WINDOW w AS (PARTITION BY key ORDER BY t, event_id))
SELECT event_id, CASE WHEN t - pt <= 2700 THEN p END AS reply_to FROM l""")
def threads(spark, sf_dir):
    """The row before of the same speaker is the parent if it is at most 45 minutes older."""
    w = Window.partitionBy("key").orderBy("t", "event_id")
    return positions(spark, sf_dir).select("event_id", F.when(F.col("t") - F.lag("t").over(w) <= 2700, F.lag("event_id").over(w)).alias("reply_to"))


@query(107, 130, sql=f"""WITH {POSITIONS}, b AS (SELECT a.event_id, arg_max(b.event_id, (b.t, b.event_id)) AS parent FROM positions a JOIN positions b ON a.event_type = b.event_type AND a.t - b.t BETWEEN 0 AND 900 AND a.key <> b.key AND b.t < a.t GROUP BY 1)
SELECT event_id, parent FROM b""")
def follow_ups(spark, sf_dir):
    """The latest earlier row of another key, same kind, within 15 minutes."""
    p = positions(spark, sf_dir).select("event_id", "event_type", "t", "key")
    return joins.latest_of_others(p, ["event_type"], "t", "event_id", "key", 900)


@query(276, sql=f"""WITH {POSITIONS}, l AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600 THEN 0 ELSE 1 END AS new FROM positions WINDOW w AS (PARTITION BY key ORDER BY t, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM l)
SELECT key, CAST(session AS BIGINT) AS session, min(t) AS first_t, max(t) AS last_t, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM s GROUP BY key, session""")
def salvos(spark, sf_dir):
    """Sessions by a gap of six hours, with time, size and centre."""
    s = ordered.sessions(positions(spark, sf_dir), ["key"], "t", 21600, "event_id")
    return s.groupBy("key", "session").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


@query(261, sql=f"""WITH {POSITIONS}, m AS (SELECT *, speed < 8 AS slow FROM positions), s AS (SELECT *, CASE WHEN slow AND NOT coalesce(lag(slow) OVER w, false) THEN 1 ELSE 0 END AS st FROM m WINDOW w AS (PARTITION BY key ORDER BY t, event_id)),
i AS (SELECT *, sum(st) OVER (PARTITION BY key ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT key, CAST(island AS BIGINT) AS island, min(t) AS arrived, max(t) AS left_, count(*) AS n FROM i WHERE slow GROUP BY key, island HAVING count(*) >= 2""")
def stops(spark, sf_dir):
    """Runs of slow fixes, two or more."""
    i = ordered.islands(positions(spark, sf_dir), ["key"], "t", "event_id", F.col("speed") < 8)
    return i.groupBy("key", "island").agg(F.min("t").alias("arrived"), F.max("t").alias("left_"), F.count("*").alias("n")).filter("n >= 2")


@query(259, 29, sql=f"""WITH {POSITIONS}, g AS (SELECT *, t - lag(t) OVER w AS gap FROM positions WINDOW w AS (PARTITION BY key ORDER BY t, event_id)), k AS (SELECT * FROM g WHERE gap IS NULL OR gap >= 300),
c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY key) AS n FROM k), s AS (SELECT *, CAST(floor((i * 20 - 1) / CAST(n AS DOUBLE)) AS BIGINT) AS slot FROM c),
x AS (SELECT *, lead(slot) OVER (PARTITION BY key ORDER BY t, event_id) AS nxt FROM s) SELECT key, event_id, t FROM x WHERE n <= 20 OR nxt IS NULL OR nxt <> slot""")
def tracks(spark, sf_dir):
    """A track a key, thinned to 20 points that are five minutes apart (the limit is the feature)."""
    return ordered.thinned(positions(spark, sf_dir), ["key"], "t", "event_id", 300, 20).select("key", "event_id", "t")


@query(262, sql=f"""WITH {POSITIONS} SELECT event_id, t, CASE WHEN lead(t) OVER w < t THEN lead(t) OVER w ELSE t END AS fixed FROM positions WINDOW w AS (PARTITION BY key ORDER BY event_id)""")
def times_in_id_order(spark, sf_dir):
    """A row later than its successor by number takes the successor's time."""
    w = Window.partitionBy("key").orderBy("event_id")
    return positions(spark, sf_dir).select("event_id", "t", F.when(F.lead("t").over(w) < F.col("t"), F.lead("t").over(w)).otherwise(F.col("t")).alias("fixed"))


@query(266, sql=f"""WITH {POSITIONS} SELECT event_type, CAST(floor(t / 3600.0) AS BIGINT) AS wave, count(*) AS n, arg_min(event_id, (t, event_id)) AS lead, count(DISTINCT key) AS tellers FROM positions GROUP BY 1, 2""")
def waves(spark, sf_dir):
    """Groups by wave key, told once, led by their first row."""
    p = positions(spark, sf_dir)
    return p.groupBy("event_type", F.floor(F.col("t") / 3600).alias("wave")).agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("t", "event_id")).alias("lead"), F.count_distinct("key").alias("tellers"))


@query(267, 268, 273, 283, sql=f"""WITH {REPORTS}, b AS (SELECT fp, source, doc_id, CASE WHEN contains(text, '!!') THEN 2 WHEN length(text) > 1000 THEN 0 ELSE 1 END AS band FROM reports), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY band, doc_id) AS place FROM b)
SELECT source, fp, CAST(band AS INTEGER) AS band, place FROM r WHERE place <= 8""")
def ranked_points(spark, sf_dir):
    """The best eight of each source by band, then age (the limit is the feature)."""
    band = F.when(F.contains("text", F.lit("!!")), 2).when(F.length("text") > 1000, 0).otherwise(1)
    b = reports(spark, sf_dir).select("source", "fp", "doc_id", band.alias("band"))
    w = Window.partitionBy("source").orderBy("band", "doc_id")
    return b.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 8").select("source", "fp", "band", "place")


@query(396, sql=f"""WITH {POSITIONS}, c AS (SELECT event_id, key, t, sum(speed) OVER (PARTITION BY key ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM positions) SELECT event_id, spent FROM c WHERE spent <= 100""")
def within_budget(spark, sf_dir):
    """Rows served before a key's budget is spent."""
    w = Window.partitionBy("key").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return positions(spark, sf_dir).select("event_id", F.sum("speed").over(w).alias("spent")).filter("spent <= 100")


@query(397, sql="""SELECT b.conv_id, b.turn, arg_max(a.turn, (len(list_intersect(string_split(a.text, ' '), string_split(b.text, ' '))), -a.turn)) AS original FROM conversations b JOIN conversations a ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1, 2""")
def originals(spark, sf_dir):
    """The earlier turn that shares most words: where a text may come from."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    both = c.join(c.select("conv_id", F.col("turn").alias("earlier"), F.col("w").alias("v")), "conv_id").filter("earlier < turn")
    score = F.struct(F.size(F.array_intersect("v", "w")), -F.col("earlier"))
    return both.groupBy("conv_id", "turn").agg(F.max_by("earlier", score).alias("original"))
