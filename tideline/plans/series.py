"""Time series: as-of lookups, changes, running maxima, means over full frames, overlays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.operators import joins, ordered
from tideline.session import DAILY, daily, table


@query(227, 228, 229, 241, 242, sql=f"""WITH {DAILY}, m AS (SELECT *, max(v) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING) AS m FROM daily) SELECT series, day, v FROM m WHERE v >= m""")
def rising(spark, sf_dir):
    return ordered.rising(daily(spark, sf_dir), ["series"], "day", "v")


@query(232, 233, 234, 423, sql=f"""WITH {DAILY}, a AS (SELECT d.series, d.day, d.v, b.v AS before_v, b.day AS before_day FROM daily d ASOF LEFT JOIN daily b ON b.series = d.series AND b.day <= d.day - 7)
SELECT series, day, v, before_v, before_day, CASE WHEN before_v IS NOT NULL THEN round((v - before_v) / before_v * 100, 1) + 0 END AS pct FROM a""")
def week_change(spark, sf_dir):
    """Each value beside the latest one of a week or more before, and the change in per cent."""
    d = daily(spark, sf_dir).withColumn("n", F.unix_date("day").cast("long"))
    moved = d.select("series", (F.col("n") + 7).alias("n"), F.struct(F.col("v").alias("v"), F.col("day").alias("day")).alias("before"))
    out = joins.as_of(d, moved, ["series"], "n", "before")
    b = F.col("before_asof")
    return out.select("series", "day", "v", b["v"].alias("before_v"), b["day"].alias("before_day"), F.round((F.col("v") - b["v"]) / b["v"] * 100, 1).alias("pct"))


@query(238, 237, 249, sql=f"""WITH {DAILY} SELECT series, day, CASE WHEN count(v) OVER w = 7 THEN round(avg(v) OVER w, 4) END AS avg7 FROM daily WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def mean_of_seven(spark, sf_dir):
    return ordered.trailing_mean(daily(spark, sf_dir), ["series"], "day", "v", 7, "avg7").select("series", "day", F.round("avg7", 4).alias("avg7"))


@query(270, sql=f"""WITH {DAILY} SELECT series, day, round(v - lag(v, 1) OVER w, 2) AS day_change, round(v - lag(v, 5) OVER w, 2) AS week_change FROM daily WINDOW w AS (PARTITION BY series ORDER BY day)""")
def changes(spark, sf_dir):
    w = Window.partitionBy("series").orderBy("day")
    return daily(spark, sf_dir).select("series", "day", F.round(F.col("v") - F.lag("v", 1).over(w), 2).alias("day_change"), F.round(F.col("v") - F.lag("v", 5).over(w), 2).alias("week_change"))


@query(269, sql="""WITH m AS (SELECT o_orderpriority AS series, year(o_orderdate) * 12 + month(o_orderdate) AS month, round(max(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)
SELECT a.series, a.month, a.v, max(b.month) AS since FROM m a LEFT JOIN m b ON b.series = a.series AND b.month < a.month AND b.v > a.v GROUP BY a.series, a.month, a.v""")
def high_since(spark, sf_dir):
    """The last earlier month with a greater maximum."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("month")).agg(F.round(F.max("o_totalprice"), 2).alias("v"))
    return ordered.previous_greater(m, ["series"], "month", "v", width=12)


@query(239, 236, sql="""WITH m AS (SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2) SELECT series, month, n, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY series), 6) AS bar FROM m""")
def month_bars(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return m.withColumn("bar", F.round(F.col("n") / F.max("n").over(Window.partitionBy("series")), 6))


@query(134, 244, 296, 231, sql="""WITH a AS (SELECT c_nationkey AS k, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, CASE WHEN s_nationkey % 2 = 0 THEN count(*) END AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.n, a.n) AS n, coalesce(b.total, a.total) AS total FROM a FULL JOIN b ON a.k = b.k""")
def overlaid(spark, sf_dir):
    """A baseline under newer cells."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    a = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    b = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.when(F.col("k") % 2 == 0, F.count("*")).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))
    return joins.overlay(a, b, ["k"])
