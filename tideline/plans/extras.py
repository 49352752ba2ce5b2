"""Composite pair rules, pin rules, spacing, covers and small grammars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import shapes, text
from tideline.lineage import cut
from tideline.operators import fold, joins
from tideline.plans.places import ports
from tideline.session import POSITIONS, REPORTS, positions, reports, table


@query(91, sql="""
WITH k AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, page_id % 3 <> 0 AS derived, length(html) AS n FROM pages),
g AS (SELECT *, count(*) OVER (PARTITION BY host) AS pins, bool_or(NOT derived) OVER (PARTITION BY host) AS named FROM k)
SELECT page_id, host FROM g WHERE NOT (pins >= 2 AND derived AND named)""")
def stray_pins(spark, sf_dir):
    """Of the pins of one outlet derived ones go where a named one stands beside them."""
    k = table(spark, sf_dir, "pages").select("page_id", text.domain(F.col("url")).alias("host"), (F.col("page_id") % 3 != 0).alias("derived"))
    g = k.groupBy("host").agg(F.count("*").alias("pins"), F.bool_or(~F.col("derived")).alias("named"))
    return k.join(g, "host").filter(~((F.col("pins") >= 2) & F.col("derived") & F.col("named"))).select("page_id", "host")


def close(p, apart=600.0):
    return joins.near(p, p, apart).filter("name_r < name").select(F.col("name_r").alias("early"), F.col("name").alias("late"))


@query(274, 415, 429, 222)
def spaced_ports(spark, sf_dir):
    """Greedy spacing: in order of name, a port within 600 km of one that stays is left out."""
    p = ports(spark, sf_dir)
    # Of names that stand at one place alone, all but the least there go, whoever stays: it is taken by the one that takes the
    # least, or by the least itself. So they need no pairs.
    at = p.distinct().groupBy("name").agg(F.count("*").alias("places"), F.min(F.struct("lat", "lon")).alias("at")).filter("places = 1 and name is not null and at.lat is not null and at.lon is not null")
    least = at.groupBy("at").agg(F.min("name").alias("least"))
    beside = cut(at.join(least, "at").filter("name > least").select("name"))
    gone = fold.greedy_homes(close(p.join(beside, "name", "left_anti").distinct())).select(F.col("late").alias("name"))
    return p.join(beside.unionByName(gone).distinct(), "name", "left_anti")


_FIG = r"list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: TRY_CAST(x AS DECIMAL(38, 0)))"


@query(sql=f"""
WITH {REPORTS}, f AS (SELECT fp, source, at_, {_FIG} AS n FROM reports), t AS (SELECT fp, source, at_, n[1] AS dead, n[2] AS hurt FROM f WHERE len(n) >= 1)
SELECT a.fp AS early, b.fp AS late, CASE WHEN a.dead = b.dead THEN true WHEN a.dead >= 3 AND b.dead >= 3 THEN abs(a.dead - b.dead) <= 1 ELSE coalesce(a.hurt = b.hurt, false) END AS meet
FROM t a JOIN t b ON a.source = b.source AND b.at_ > a.at_ AND b.at_ - a.at_ <= 43200""")
def tolls(spark, sf_dir):
    """Do two reports of a source within 12 hours give the same toll: first figures equal, or one apart from three on, or
    second figures equal."""
    found = F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))
    t = reports(spark, sf_dir).select("fp", "source", "at", F.get(found, F.lit(0)).try_cast("decimal(38,0)").alias("dead"), F.get(found, F.lit(1)).try_cast("decimal(38,0)").alias("hurt")).filter("dead is not null")
    both = joins.interval_join(t, t, ["source"], "at", 43200).filter("at_r < at")
    meet = F.when(F.col("dead") == F.col("dead_r"), True).when((F.col("dead") >= 3) & (F.col("dead_r") >= 3), F.abs(F.col("dead") - F.col("dead_r")) <= 1).otherwise(F.coalesce(F.col("hurt") == F.col("hurt_r"), F.lit(False)))
    return both.select(F.col("fp_r").alias("early"), F.col("fp").alias("late"), meet.alias("meet"))


@query(316, 194, sql=rf"""
WITH {REPORTS}, w AS (SELECT DISTINCT fp, unnest(list_filter(regexp_split_to_array(lower(summary), '[^\p{{L}}\p{{Nd}}]+'), lambda x: length(x) >= 4)) AS word FROM reports),
d AS (SELECT word, count(*) AS df FROM w GROUP BY word), r AS (SELECT fp, word, row_number() OVER (PARTITION BY fp ORDER BY df, word) AS k FROM w JOIN d USING (word))
SELECT fp, string_agg(word, ' ' ORDER BY k) AS keys FROM r WHERE k <= 4 GROUP BY fp""")
def search_keys(spark, sf_dir):
    """The four most telling words of each headline, rare ones first (the limit is the query's length)."""
    w = reports(spark, sf_dir).select("fp", F.explode(F.array_distinct(F.filter(text.words(F.col("summary")), lambda x: F.length(x) >= 4))).alias("word"))
    ranked = w.join(w.groupBy("word").agg(F.count("*").alias("df")), "word").withColumn("k", F.row_number().over(Window.partitionBy("fp").orderBy("df", "word")))
    keys = ranked.filter("k <= 4").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("s"))
    return keys.select("fp", F.array_join(F.col("s.word"), " ").alias("keys"))


@query(352, sql="""
WITH p AS (SELECT s_name AS name, s_suppkey % 100 - 50 + 0.5 AS lat, s_suppkey * 7 % 300 - 150 + 0.5 AS lon FROM supplier)
SELECT name, CAST(lat + dy * 0.5 AS DOUBLE) AS lat, CAST(lon + dx * 0.5 + (dy % 2) * 0.25 AS DOUBLE) AS lon FROM p, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)""")
def lattice(spark, sf_dir):
    """Centres of circles in staggered rows that cover the box around each port."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = ports(spark, sf_dir).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return p.select("name", (F.col("lat") + F.col("dy") * 0.5).cast("double").alias("lat"), (F.col("lon") + F.col("dx") * 0.5 + (F.col("dy") % 2) * 0.25).cast("double").alias("lon"))


@query(sql="""
SELECT o_orderkey, regexp_extract(s, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS from_day, regexp_extract(s, ' to ([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS to_day
FROM (SELECT o_orderkey, 'from ' || strftime(o_orderdate, '%Y-%m-%d') || ' to ' || strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS s FROM orders)""")
def date_ranges(spark, sf_dir):
    """Ranges that a text gives, read back."""
    d = F.to_date("o_orderdate")
    s = F.concat(F.lit("from "), F.date_format(d, "yyyy-MM-dd"), F.lit(" to "), F.date_format(F.date_add(d, 7), "yyyy-MM-dd"))
    day = "([0-9]{4}-[0-9]{2}-[0-9]{2})"
    return table(spark, sf_dir, "orders").select("o_orderkey", F.regexp_extract(s, day, 1).alias("from_day"), F.regexp_extract(s, f" to {day}", 1).alias("to_day"))


@query(362, 428)
def shaped_tracks(spark, sf_dir):
    """Each key's daily track, simplified, and its part inside a box."""
    p = positions(spark, sf_dir).groupBy("key", F.floor(F.col("t") / 86400).alias("day")).agg(F.array_sort(F.collect_list(F.struct("t", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("s"))
    ring = F.transform("s", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    box = (-100.0, -40.0, 100.0, 40.0)
    return p.select("key", "day", F.size("s").alias("n"), F.size(shapes.simplified(0.5)(ring)).alias("n_simple"), F.size(shapes.clipped(box)(ring)).alias("n_inside"))


@query(292, sql=f"""WITH {POSITIONS}, u AS (SELECT key, t, event_id, 0 AS settled FROM positions WHERE event_type <> 'error' UNION ALL SELECT key, t, event_id, 1 FROM positions WHERE event_type IN ('error', 'purchase')),
b AS (SELECT event_id, max(settled) AS settled, any_value(key) AS key, any_value(t) AS t FROM u GROUP BY event_id), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, event_id DESC) AS k FROM b)
SELECT event_id, settled FROM r WHERE k <= 10""")
def queue(spark, sf_dir):
    """Settled rows (purchases, errors) replace waiting ones (all but errors) of the same number; the last ten of a key stay (the limit is the feature)."""
    p = positions(spark, sf_dir).select("key", "t", "event_id", "event_type")
    u = p.filter("event_type <> 'error'").withColumn("settled", F.lit(0)).unionByName(p.filter("event_type in ('error', 'purchase')").withColumn("settled", F.lit(1)))
    b = u.groupBy("event_id", "key", "t").agg(F.max("settled").alias("settled"))
    w = Window.partitionBy("key").orderBy(F.desc("t"), F.desc("event_id"))
    return b.withColumn("k", F.row_number().over(w)).filter("k <= 10").select("event_id", "settled")
