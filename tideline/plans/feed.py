"""The store and its reads: feed pages, upserts, tombstones, fan-out, queues, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.operators.ordered import numbered
from tideline.functions import text
from tideline.operators import store
from tideline.plans.scalars import _ARGS, _LINK
from tideline.session import REPORTS, micros, reports, table


@query(36, 37, 44, 45, 285, sql=f"""WITH {REPORTS} SELECT fp, at_ AS at, source, summary FROM reports
WHERE desk = 'en' AND at_ < 1704067200 + 420 * 900 AND length(summary) >= 8 ORDER BY at_ DESC, fp LIMIT 50""")
def feed_page(spark, sf_dir):
    """One page of a desk's feed, newest first, before a cursor (the limit is the page size)."""
    r = reports(spark, sf_dir).filter(F.length("summary") >= 8)
    return store.page(r, desk="en", before=1704067200 + 420 * 900, limit=50).select("fp", "at", "source", "summary")


@query(31, 32, 33, 34, 36, 41, 46, 135, 231, 291, 296, sql="""
WITH base AS (SELECT c_custkey AS k, c_mktsegment AS v, [c_mktsegment] AS desks, c_acctbal AS first_seen, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS media FROM customer WHERE c_acctbal >= 0),
fresh AS (SELECT c_custkey AS k, 'NEW' AS v, ['NEW', c_mktsegment] AS desks, c_acctbal - 5 AS first_seen, c_name AS media FROM customer WHERE c_acctbal < 5000),
gone AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal >= 4000 AND c_mktsegment = 'BUILDING')
SELECT coalesce(b.k, f.k) AS k, coalesce(f.v, b.v) AS v, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.desks, []), coalesce(f.desks, [])))), ',') AS desks,
  round(CASE WHEN b.first_seen IS NULL THEN f.first_seen WHEN f.first_seen IS NULL THEN b.first_seen ELSE least(b.first_seen, f.first_seen) END, 2) AS first_seen, coalesce(b.media, f.media) AS media
FROM base b FULL JOIN fresh f ON b.k = f.k WHERE coalesce(b.k, f.k) NOT IN (SELECT k FROM gone)""")
def upsert(spark, sf_dir):
    """Customers in credit, and anew those under 5000 (every customer is one or both): new values win, arrays unite, first
    times only move back, media only fill gaps, tombstones stay away."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    base = c.filter("c_acctbal >= 0").select("k", F.col("c_mktsegment").alias("v"), F.array("c_mktsegment").alias("desks"), F.col("c_acctbal").alias("first_seen"), F.when(F.col("k") % 3 == 0, F.col("c_name")).alias("media"))
    fresh = c.filter("c_acctbal < 5000").select("k", F.lit("NEW").alias("v"), F.array(F.lit("NEW"), "c_mktsegment").alias("desks"), (F.col("c_acctbal") - 5).alias("first_seen"), F.col("c_name").alias("media"))
    out = store.merge(base, fresh, c.filter("c_acctbal >= 4000 and c_mktsegment = 'BUILDING'").select("k"), key="k", replace=["v"], unite=["desks"], least=["first_seen"], fill=["media"])
    return out.select("k", "v", F.array_join(F.array_sort("desks"), ",").alias("desks"), F.round("first_seen", 2).alias("first_seen"), "media")


@query(28, 47, 297, 295, sql=f"""WITH k AS (SELECT page_id, {_LINK} || CASE WHEN len({_ARGS}) > 0 THEN '?' || array_to_string({_ARGS}, '&') ELSE '' END AS link FROM pages)
SELECT page_id, link FROM k a WHERE page_id % 2 = 0 UNION ALL
SELECT page_id, link FROM k a WHERE page_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.page_id % 2 = 0 AND b.link = a.link)""")
def with_archive(spark, sf_dir):
    """Stored rows, and archive rows that are stored under no key."""
    p = table(spark, sf_dir, "pages").select("page_id", text.link_key(F.col("url")).alias("link"))
    return store.with_archive(p.filter("page_id % 2 = 0"), p.filter("page_id % 2 = 1"), ["page_id", "link"])


@query(26, 39, 55, 125, sql=f"""WITH {REPORTS}, l AS (
  SELECT fp, unnest(string_split(text, chr(10))) AS label, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM reports)
SELECT fp || CASE WHEN k = 1 THEN '' ELSE '-pin-' || CAST(k AS VARCHAR) END AS pin, fp AS parent, md5(label) AS label FROM l WHERE length(trim(label)) > 0""")
def pins(spark, sf_dir):
    """One report to any number of pins, whose key leads back to the report."""
    lines = reports(spark, sf_dir).select("fp", F.posexplode(F.split("text", "\n")).alias("i", "label")).filter(F.length(F.trim("label")) > 0)
    pin = F.concat("fp", F.when(F.col("i") == 0, "").otherwise(F.concat(F.lit("-pin-"), (F.col("i") + 1).cast("string"))))
    return lines.select(pin.alias("pin"), F.regexp_replace(pin, "-pin-.*$", "").alias("parent"), F.md5("label").alias("label"))


@query(35, 38, 109, 218, sql="""SELECT c.conv_id, c.turn, CASE WHEN p.turn IS NOT NULL THEN p.turn END AS reply_to FROM conversations c LEFT JOIN conversations p
ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role <> c.role""")
def checked_parents(spark, sf_dir):
    """A parent pointer holds only where the older row exists and may be answered; else it is null."""
    c = table(spark, sf_dir, "conversations")
    return store.checked_parents(c.select("conv_id", "turn", "role", (F.col("turn") - 1).alias("parent")), c.select("conv_id", "turn", "role"))


@query(40, 43, 56, 140, 284, sql="""SELECT user_id, CAST(max(epoch_us(ts)) AS BIGINT) AS last_us, CAST(arg_max(event_id, (epoch_us(ts), event_id)) AS BIGINT) AS event_id, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type
FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY user_id""")
def latest_state(spark, sf_dir):
    """Key/value state: last write wins, old rows pruned."""
    e = table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return store.latest(e.select("user_id", micros(F.col("ts")).alias("last_us"), "event_id", "event_type"), ["user_id"], ["last_us", "event_id"])


@query(51, sql="""SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 14 DAY GROUP BY 1""")
def snapshots(spark, sf_dir):
    """Daily snapshots within the retention of 14 days, counted."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") > F.expr("timestamp_ntz '2001-08-01 00:00:00' - interval 14 days"))
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(52, 141, sql="""SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events""")
def exploded_blob(spark, sf_dir):
    """One JSON object to key/value rows."""
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")))


@query(282, sql=f"""WITH {REPORTS} SELECT fp, row_number() OVER (PARTITION BY source ORDER BY at_ DESC, fp) AS turn, source FROM reports""")
def interleaved(spark, sf_dir):
    """Round robin over sources, newest first inside each; rows come out in serving order."""
    r = numbered(reports(spark, sf_dir).select("fp", "source", "at"), ["source"], "at", ["fp"], "turn", width=14 * 86400, falling=True)
    return r.select("fp", "turn", "source").orderBy("turn", "source")


@query(289, 290, 298, 294, 272, sql="""
WITH g AS (SELECT l_orderkey, list_distinct(list(l_returnflag ORDER BY l_linenumber, l_partkey)) AS a, list_distinct(list(l_linestatus)) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), '') AS united, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INTEGER) AS only_a,
  CASE WHEN len(list_filter(a, lambda x: x <> 'A')) > 0 THEN array_to_string(list_sort(list_filter(a, lambda x: x <> 'A')), '') ELSE array_to_string(list_sort(a), '') END AS kept FROM g""")
def array_sets(spark, sf_dir):
    """Union, difference, and a difference that never empties a set."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    rest = F.array_remove("a", "A")
    return g.select(
        "l_orderkey", F.array_join(F.array_sort(F.array_union("a", "b")), "").alias("united"), F.size(F.array_except("a", "b")).alias("only_a"),
        F.array_join(F.array_sort(F.when(F.size(rest) > 0, rest).otherwise(F.col("a"))), "").alias("kept"),
    )
