"""Aggregates: source ratings, briefs by front and in total, tempo, shares, lexicons, streaks, meters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import text
from tideline.session import POSITIONS, REPORTS, positions, reports, table

_PRIOR, _WEIGHT = 3.5, 5.0


@query(212, 213, 215, 216, 217, sql=f"""WITH s AS (SELECT l_suppkey, 1 + 4 * (1 - l_discount * 10 / 2) AS score, 1 + l_quantity / 50 AS w FROM lineitem)
SELECT l_suppkey, count(*) AS n, round(({_PRIOR} * {_WEIGHT} + sum(score * w)) / ({_WEIGHT} + sum(w)), 4) AS rating FROM s GROUP BY 1 HAVING count(*) >= 3""")
def ratings(spark, sf_dir):
    """Weighted means with a prior, for those rated three times or more."""
    s = table(spark, sf_dir, "lineitem").select("l_suppkey", (1 + 4 * (1 - F.col("l_discount") * 10 / 2)).alias("score"), (1 + F.col("l_quantity") / 50).alias("w"))
    blend = (_PRIOR * _WEIGHT + F.sum(F.col("score") * F.col("w"))) / (_WEIGHT + F.sum("w"))
    return s.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(blend, 4).alias("rating")).filter("n >= 3")


@query(214, 215, 278, 281, sql="""SELECT l_orderkey, count(DISTINCT l_returnflag) AS sides, count(DISTINCT l_suppkey) AS tellers, round(CAST(least(5.0, 2.0 + count(DISTINCT l_returnflag) * 0.5 + count(DISTINCT l_suppkey) * 0.25) AS DOUBLE), 2) AS credibility,
  arg_max(l_linenumber, (l_extendedprice, -l_linenumber, l_partkey)) AS lead FROM lineitem GROUP BY 1""")
def confirmation(spark, sf_dir):
    """How many sides and tellers confirm, the score that gives, and the lead (largest, then first)."""
    sides, tellers = F.count_distinct("l_returnflag"), F.count_distinct("l_suppkey")
    lead = F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"), "l_partkey"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(sides.alias("sides"), tellers.alias("tellers"), F.round(F.least(F.lit(5.0), 2.0 + sides * 0.5 + tellers * 0.25), 2).alias("credibility"), lead.alias("lead"))


_HOURS = f"""{POSITIONS}, h AS (SELECT CAST(floor(t / 10800.0) AS BIGINT) * 10800 AS w, event_type AS front, event_type = 'error' AS strike, value FROM positions)"""


@query(218, 219, 221, 235, 381, 334, sql=f"""WITH {_HOURS} SELECT w, front, count(*) AS n, count(*) FILTER (strike) AS strikes, round(sum(value), 2) AS total FROM h GROUP BY GROUPING SETS ((w, front), (w))""")
def brief(spark, sf_dir):
    """Counts of each three-hour window, by front and in total, in one pass."""
    h = positions(spark, sf_dir).select((F.floor(F.col("t") / 10800) * 10800).alias("w"), F.col("event_type").alias("front"), (F.col("event_type") == "error").alias("strike"), "value")
    return h.groupingSets([["w", "front"], ["w"]], "w", "front").agg(F.count("*").alias("n"), F.count_if("strike").alias("strikes"), F.round(F.sum("value"), 2).alias("total"))


@query(220, sql=f"""WITH {_HOURS}, c AS (SELECT w, count(*) AS n FROM h GROUP BY w), l AS (SELECT w, n, lag(n) OVER (ORDER BY w) AS p FROM c)
SELECT w, n, CASE WHEN p IS NULL THEN 'first' WHEN n >= p * 1.25 THEN 'up' WHEN n <= p * 0.8 THEN 'down' ELSE 'level' END AS tempo FROM l""")
def tempo(spark, sf_dir):
    """Each window beside the one before. One row a window reaches the unpartitioned sort."""
    c = positions(spark, sf_dir).groupBy((F.floor(F.col("t") / 10800) * 10800).alias("w")).agg(F.count("*").alias("n"))
    p = F.lag("n").over(Window.orderBy("w"))
    return c.select("w", "n", F.when(p.isNull(), "first").when(F.col("n") >= p * 1.25, "up").when(F.col("n") <= p * 0.8, "down").otherwise("level").alias("tempo"))


@query(226, sql="""WITH s AS (SELECT n_regionkey AS region, sum(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT region, round(v * 100 / sum(v) OVER (), 2) AS share FROM s""")
def shares(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region")).agg(F.sum("s_acctbal").alias("v"))
    return s.select("region", F.round(F.col("v") * 100 / F.sum("v").over(Window.partitionBy()), 2).alias("share"))


@query(240, 254, 255, 256, sql=f"""WITH {POSITIONS}, c AS (SELECT CAST(floor(t / 86400.0) AS BIGINT) AS day, event_type AS route, count(*) AS n, round(sum(value), 2) AS spent FROM positions GROUP BY 1, 2)
SELECT day, route, n, spent FROM c WHERE day > (SELECT max(day) FROM c) - 7""")
def meter(spark, sf_dir):
    """Counts and sums by day and route, the last seven days kept."""
    c = positions(spark, sf_dir).groupBy(F.floor(F.col("t") / 86400).alias("day"), F.col("event_type").alias("route")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("spent"))
    last = positions(spark, sf_dir).agg(F.floor(F.max("t") / 86400).alias("last"))
    return c.crossJoin(F.broadcast(last)).filter("day > last - 7").drop("last")  # one row


@query(250, sql=f"""WITH {REPORTS}, w AS (SELECT DISTINCT fp, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')) AS word FROM reports)
SELECT word, count(*) AS df FROM w GROUP BY word HAVING count(*) >= 3""")
def lexicon(spark, sf_dir):
    """Words by how many reports have them."""
    w = reports(spark, sf_dir).select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("df")).filter("df >= 3")


@query(sql="""SELECT n_name AS name, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS titles FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def names_and_titles(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("titles"))


@query(258, sql=f"""WITH {POSITIONS}, d AS (SELECT DISTINCT key, CAST(floor(t / 86400.0) AS BIGINT) AS day FROM positions), g AS (SELECT key, day, day - row_number() OVER (PARTITION BY key ORDER BY day) AS run FROM d)
SELECT key, min(day) AS from_day, count(*) AS days FROM g GROUP BY key, run""")
def streaks(spark, sf_dir):
    """Runs of days on which a key was active."""
    d = positions(spark, sf_dir).select("key", F.floor(F.col("t") / 86400).alias("day")).distinct()
    d = d.withColumn("run", F.col("day") - F.row_number().over(Window.partitionBy("key").orderBy("day")))
    return d.groupBy("key", "run").agg(F.min("day").alias("from_day"), F.count("*").alias("days")).drop("run")


@query(243, 245, sql="""WITH r AS (SELECT l_orderkey, l_shipmode_rank, l_extendedprice, l_linenumber, l_partkey FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS l_shipmode_rank FROM lineitem))
SELECT l_orderkey, arg_max(l_extendedprice, (l_shipmode_rank, l_extendedprice, l_linenumber)) AS figure, max(l_shipmode_rank) AS rank FROM r GROUP BY 1""")
def best_source(spark, sf_dir):
    """The figure of the best ranked source, the larger one among equals."""
    r = table(spark, sf_dir, "lineitem").withColumn("rank", F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 2).otherwise(1))
    b = r.groupBy("l_orderkey").agg(F.max(F.struct("rank", "l_extendedprice", "l_linenumber")).alias("b"))
    return b.select("l_orderkey", F.col("b.l_extendedprice").alias("figure"), F.col("b.rank").alias("rank"))


@query(277, 305, sql=f"""WITH {REPORTS}, s AS (SELECT fp, at_, CASE WHEN contains(lower(summary), 'the') THEN 3 WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(summary), 'ing') OR contains(lower(summary), 'ent') THEN 3 WHEN contains(lower(text), 'ing') OR contains(lower(text), 'ent') THEN 1 ELSE 0 END AS score,
  CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'ing') OR contains(lower(text), 'ent') THEN 1 ELSE 0 END AS met FROM reports)
SELECT fp, CAST(score AS INTEGER) AS score FROM s WHERE met = 2 ORDER BY score DESC, at_ DESC LIMIT 300""")
def search(spark, sf_dir):
    """All of a query's groups of alternatives, headline words counting more; the best 300 (the limit is the page)."""
    from tideline.operators.search import ranked

    return ranked(reports(spark, sf_dir), [["the"], ["ing", "ent"]], 300).select("fp", "score")
