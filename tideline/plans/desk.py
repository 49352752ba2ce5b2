"""Rows of a desk: classes, shapes, siblings, outlets, windows that widen, limits and evictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import text
from tideline.operators import joins
from tideline.session import POSITIONS, REPORTS, positions, reports, table

_KINDS = ("view", "click", "purchase", "signup", "error")


@query(60, 63, 93, 287, 411, 412, sql="""
WITH c AS (SELECT event_id, event_type, CASE WHEN user_id % 10 < 2 THEN 'wire' WHEN event_type IN ('purchase', 'signup') THEN 'focused' ELSE 'mixed' END AS breadth,
  event_type IN ('purchase', 'error') AS on_map, event_type IN ('view', 'click', 'purchase', 'signup', 'error') AS known, value FROM events)
SELECT event_id, breadth, on_map, known, CASE breadth WHEN 'wire' THEN CAST(4 AS DOUBLE) WHEN 'focused' THEN 3.5 ELSE 3 END AS start,
  CASE WHEN on_map AND breadth = 'wire' THEN 0 WHEN on_map THEN 1 WHEN value >= 100 THEN 2 ELSE 3 END AS fetch_rank FROM c""")
def source_classes(spark, sf_dir):
    """Breadth of a source by ordered rules, whether a kind goes on the map and is one at all, the rating a class starts
    from, and the rank in a fetch budget."""
    kind, who = F.col("event_type"), F.col("user_id") % 10
    e = table(spark, sf_dir, "events").withColumn("breadth", F.when(who < 2, "wire").when(kind.isin("purchase", "signup"), "focused").otherwise("mixed"))
    e = e.withColumns({"on_map": kind.isin("purchase", "error"), "known": kind.isin(*_KINDS)})
    start = F.when(F.col("breadth") == "wire", 4.0).when(F.col("breadth") == "focused", 3.5).otherwise(3.0)
    rank = F.when(F.col("on_map") & (F.col("breadth") == "wire"), 0).when(F.col("on_map"), 1).when(F.col("value") >= 100, 2).otherwise(3)
    return e.select("event_id", "breadth", "on_map", "known", start.alias("start"), rank.alias("fetch_rank"))


@query(53, 54, sql=rf"""WITH {REPORTS}, s AS (SELECT fp, nullif(trim(replace(coalesce(summary, ''), chr(1), '')), '') AS summary, nullif(source, '') AS source,
  CASE WHEN length(text) > length(summary) THEN md5(text) END AS body FROM reports)
SELECT fp, md5(summary) AS summary, source, body, CAST(summary IS NOT NULL AS INTEGER) + CAST(source IS NOT NULL AS INTEGER) + CAST(body IS NOT NULL AS INTEGER) AS fields FROM s""")
def stored_rows(spark, sf_dir):
    """Reports as they are stored: control characters that a text store refuses go, empty fields are left out, a body only
    where it says more than the headline."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("summary", F.lit("")), "\x00", ""), "\x01", "")
    s = reports(spark, sf_dir).select("fp", F.nullif(F.trim(bare), F.lit("")).alias("s"), F.nullif("source", F.lit("")).alias("source"), F.when(F.length("text") > F.length("summary"), F.md5("text")).alias("body"))
    fields = sum((F.col(c).isNotNull().cast("int") for c in ("s", "source", "body")), F.lit(0))
    return s.select("fp", F.md5("s").alias("summary"), "source", "body", fields.alias("fields"))


@query(380, 129, sql=f"""WITH {REPORTS}, l AS (SELECT r.fp, r.at_, r.source, max(l.quality) AS quality FROM reports r JOIN labels l ON l.doc_id = r.doc_id GROUP BY ALL),
n AS (SELECT r.fp, arg_min(l.fp, (abs(l.at_ - r.at_), l.fp)) AS sibling FROM reports r JOIN l ON l.source = r.source AND abs(l.at_ - r.at_) <= 1800 AND l.fp <> r.fp GROUP BY r.fp)
SELECT r.fp, n.sibling, l.quality FROM reports r LEFT JOIN n ON n.fp = r.fp LEFT JOIN l ON l.fp = coalesce(n.sibling, '')""")
def labelled_siblings(spark, sf_dir):
    """Each report with the nearest other one of its source within half an hour that has a label, and that label."""
    r = reports(spark, sf_dir).select("fp", "doc_id", "at", "source")
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = r.join(known, "doc_id").select("fp", "at", "source", "quality")
    both = joins.interval_join(r.drop("doc_id"), marked, ["source"], "at", 1800, 1800).filter("fp <> fp_r")
    best = both.groupBy("fp").agg(F.min_by(F.struct("fp_r", "quality_r"), F.struct(F.abs(F.col("at_r") - F.col("at")), "fp_r")).alias("b"))
    return r.join(best, "fp", "left").select("fp", F.col("b.fp_r").alias("sibling"), F.col("b.quality_r").alias("quality"))


def fnv1a(c):
    """32-bit FNV-1a of the ASCII characters of a text, in base 36."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda s, x: F.pmod(s.bitwiseXOR(x) * 16777619, F.lit(1 << 32)))
    return F.lower(F.conv(h.cast("string"), 10, 36))


@query(197, 313, sql=r"""
WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_replace(url, '[#].*$', '') AS bare FROM pages),
n AS (SELECT *, regexp_replace(regexp_extract(host, '^(?:m\.|blog\.)?(.*?)\.[a-z]+\.[a-z]+$', 1), '-', ' ', 'g') AS name FROM h),
o AS (SELECT *, upper(left(name, 1)) || substr(name, 2) AS outlet, list_reduce([CAST(2166136261 AS BIGINT)] || list_transform(list_filter(regexp_split_to_array(bare, ''), lambda x: x <> ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda s, x: (xor(s, x) * 16777619) % 4294967296) AS h FROM n),
k AS (SELECT outlet, count(DISTINCT host) AS hosts FROM o GROUP BY outlet)
SELECT page_id, outlet, lower(to_base(h, 36)) AS url_key, hosts FROM o JOIN k USING (outlet)""")
def outlets(spark, sf_dir):
    """Outlet of a page by its host (mobile and blog hosts are the outlet's own), the key of its address, and how many hosts
    the outlet has."""
    host = text.domain(F.col("url"))
    name = F.regexp_replace(F.regexp_extract(host, r"^(?:m\.|blog\.)?(.*?)\.[a-z]+\.[a-z]+$", 1), "-", " ")
    p = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.concat(F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2))).alias("outlet"), fnv1a(F.regexp_replace("url", "[#].*$", "")).alias("url_key"))
    return p.join(p.groupBy("outlet").agg(F.count_distinct("host").alias("hosts")), "outlet").select("page_id", "outlet", "url_key", "hosts")


@query(257, sql=f"""WITH {REPORTS}, e AS (SELECT desk, max(at_) AS e FROM reports GROUP BY desk),
c AS (SELECT r.desk, e, count(*) FILTER (WHERE at_ > e - 10800) AS a, count(*) FILTER (WHERE at_ > e - 21600) AS b, count(*) FILTER (WHERE at_ > e - 32400) AS c FROM reports r JOIN e ON e.desk = r.desk GROUP BY r.desk, e)
SELECT desk, e - 10800 * CASE WHEN a >= 20 THEN 1 WHEN b >= 20 THEN 2 WHEN c >= 20 THEN 3 ELSE 4 END AS start FROM c""")
def brief_starts(spark, sf_dir):
    """Where a desk's brief begins: three hours back from its newest report, and three more until there are twenty reports or
    it is twelve."""
    r = reports(spark, sf_dir).select("desk", "at")
    e = r.groupBy("desk").agg(F.max("at").alias("e"))
    back = lambda k: F.count_if(F.col("at") > F.col("e") - 10_800 * k)
    c = r.join(e, "desk").groupBy("desk", "e").agg(*(back(k).alias(f"n{k}") for k in (1, 2, 3)))
    steps = F.when(F.col("n1") >= 20, 1).when(F.col("n2") >= 20, 2).when(F.col("n3") >= 20, 3).otherwise(4)
    return c.select("desk", (F.col("e") - 10_800 * steps).alias("start"))


@query(246, 247, sql=f"""WITH {REPORTS}, k AS (SELECT fp, CASE WHEN source LIKE '%3' THEN 'official' ELSE 'ledger' END AS list, at_ FROM reports WHERE length(text) >= 200),
o AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY at_ DESC, fp) AS k FROM k) SELECT list, fp FROM o WHERE k <= CASE WHEN list = 'official' THEN 30 ELSE 90 END""")
def reading_lists(spark, sf_dir):
    """The newest ninety reports for the ledger and the newest thirty official ones (the numbers are the feature)."""
    r = reports(spark, sf_dir).filter(F.length("text") >= 200).select("fp", "at", F.when(F.col("source").like("%3"), "official").otherwise("ledger").alias("list"))
    newest = Window.partitionBy("list").orderBy(F.desc("at"), "fp")
    top = r.withColumn("k", F.row_number().over(newest)).filter("k <= 90")
    return top.filter("list = 'ledger' or k <= 30").select("list", "fp")


@query(337, 338, sql=f"""WITH {REPORTS} SELECT fp, strftime(to_timestamp(at_ + 10800) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+03:00' AS iso,
  strftime(to_timestamp(at_) AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') AS quota_day FROM reports""")
def stamps(spark, sf_dir):
    """Times as text at a fixed offset, and the day of a quota that starts at midnight on the Pacific coast."""
    at = F.timestamp_seconds("at")
    iso = F.concat(F.date_format(F.timestamp_seconds(F.col("at") + 10_800), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00"))
    return reports(spark, sf_dir).select("fp", iso.alias("iso"), F.date_format(F.from_utc_timestamp(at, "America/Los_Angeles"), "yyyy-MM-dd").alias("quota_day"))


@query(286, sql="""WITH e AS (SELECT event_id, user_id % 50 AS visitor, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)
SELECT event_id, visitor, count(*) OVER (PARTITION BY visitor ORDER BY t RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) AS lately FROM e QUALIFY lately > 2""")
def over_the_limit(spark, sf_dir):
    """Requests of a visitor beyond two in ten minutes, the window sliding. Each request counts in its bucket of ten minutes
    and, for the ones after it, in the next: a busy visitor is spread over time."""
    e = positions(spark, sf_dir).select("event_id", (F.col("key") % 50).alias("visitor"), "t")
    b = F.floor(F.col("t") / 600)
    both = e.withColumn("own", F.lit(True)).withColumn("b", b).unionByName(e.withColumn("own", F.lit(False)).withColumn("b", b + 1))
    lately = F.count("*").over(Window.partitionBy("visitor", "b").orderBy("t").rangeBetween(-599, 0))
    return both.withColumn("lately", lately).filter("own and lately > 2").select("event_id", "visitor", "lately")


@query(374, 375, 377, sql=f"""WITH {POSITIONS}, n AS (SELECT max(t) AS now FROM positions), l AS (SELECT key, arg_max(lat, (t, event_id)) AS lat, arg_max(lon, (t, event_id)) AS lon, max(t) AS t FROM positions GROUP BY key),
s AS (SELECT l.*, now - t AS age, lat BETWEEN -10 AND 10 AS inside FROM l, n)
SELECT key, CASE WHEN age > 86400 THEN 'dropped' WHEN age > 21600 AND inside THEN 'left' WHEN age > 21600 THEN 'stale' ELSE 'live' END AS state,
  CASE WHEN age <= 86400 THEN round(lat, 6) END AS lat, CASE WHEN age <= 86400 THEN round(lon, 6) END AS lon FROM s""")
def evictions(spark, sf_dir):
    """The last fix of each key: gone after a day; after six hours gone, too, if the last reading covers its place and does
    not have it, else kept as stale."""
    p = positions(spark, sf_dir)
    last = p.groupBy("key").agg(F.max_by(F.struct("lat", "lon"), F.struct("t", "event_id")).alias("at"), F.max("t").alias("t"))
    s = last.crossJoin(F.broadcast(p.agg(F.max("t").alias("now")))).withColumn("age", F.col("now") - F.col("t"))  # one row
    state = F.when(F.col("age") > 86_400, "dropped").when((F.col("age") > 21_600) & F.col("at.lat").between(-10, 10), "left").when(F.col("age") > 21_600, "stale").otherwise("live")
    kept = lambda c: F.when(F.col("age") <= 86_400, F.round(F.col(f"at.{c}"), 6)).alias(c)
    return s.select("key", state.alias("state"), kept("lat"), kept("lon"))
