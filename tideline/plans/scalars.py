"""Queries that show the scalar functions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import clock, geo, text
from tideline.session import POSITIONS, REPORTS, positions, reports, table

_W = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"
_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[''’]', '', 'g'), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


#: A first letter as a capital, letters that become several ones (ß: SS) too, which DuckDB's upper maps one to one or not at all.
_CAPITAL = "CASE left(norm, 1) " + " ".join(f"WHEN '{chr(n)}' THEN '{chr(n).upper()}'" for n in range(0x10000) if len(chr(n).upper()) > 1) + " ELSE upper(left(norm, 1)) END"


@query(138, 143, 144, 152, 195, 196, 199, 299, 311, 325, 326, 327, sql=rf"""
WITH {REPORTS}, k AS (
  SELECT fp, summary, {_NORM.format('summary')} AS norm, trim(regexp_replace(regexp_replace(lower(regexp_replace(text, 'https?://[^\s]+|@[A-Za-z0-9_]+', ' ', 'g')), '[''’]', '', 'g'), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')) AS bare,
    regexp_replace({_SQUEEZE.format('summary')}, '[.;, ]+$', '') AS one, {_W.format('summary')} AS w
  FROM reports
)
SELECT fp, norm, array_to_string(w[1:14], ' ') AS title_key, left(regexp_replace(regexp_replace(lower(summary), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 72) AS slug,
  CASE WHEN length(bare) < 40 THEN '' ELSE md5(left(bare, 200)) END AS content_key,
  CASE WHEN length(one) <= 140 THEN one ELSE regexp_replace(left(one, 139), ' [^ ]*$', '') || '…' END AS headline,
  {_CAPITAL} || lower(substr(norm, 2)) AS sentence
FROM k""")
def text_keys(spark, sf_dir):
    r = reports(spark, sf_dir)
    return r.select(
        "fp", text.norm(F.col("summary")).alias("norm"), text.title_key(F.col("summary")).alias("title_key"), text.slug(F.col("summary")).alias("slug"),
        text.content_key(F.col("text")).alias("content_key"), text.tidy_headline(F.col("summary")).alias("headline"),
        text.sentence_case(text.norm(F.col("summary"))).alias("sentence"),
    )


@query(86, 155, 319, 418, sql=rf"""
WITH {REPORTS}, f AS (
  SELECT fp, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '([0-9]),([0-9]{{3}})', '\1\2', 'g'), '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT)),
    lambda n: n IS NOT NULL AND NOT n BETWEEN 1900 AND 2100) AS n FROM reports
)
SELECT fp, CAST(len(n) AS INTEGER) AS n_figures, CAST(coalesce(list_max(n), 0) AS BIGINT) AS largest,
  CAST(len(list_distinct(list_filter(n, lambda x: x >= 100 AND x % 50 <> 0))) AS INTEGER) AS n_rare FROM f""")
def figures(spark, sf_dir):
    n = text.numbers(F.col("text"))
    return reports(spark, sf_dir).select(
        "fp", F.size(n).alias("n_figures"), F.coalesce(F.array_max(n), F.lit(0)).alias("largest"), F.size(text.rare_figures(F.col("text"))).alias("n_rare"),
    )


_LINK = r"""lower(regexp_replace(regexp_replace(split_part(regexp_replace(url, '#.*$', ''), '?', 1), '^https?://(www\.|m\.)?', ''), '/$', ''))"""
_ARGS = r"""list_sort(list_filter(string_split(split_part(regexp_replace(url, '#.*$', ''), '?', 2), '&'), lambda a: a <> '' AND NOT regexp_matches(a, '^(utm_[a-z]+|ref|fbclid|gclid)=')))"""


@query(81, 82, 180, 198, 312, 314, sql=rf"""
SELECT page_id, {_LINK} || CASE WHEN len({_ARGS}) > 0 THEN '?' || array_to_string({_ARGS}, '&') ELSE '' END AS link_key,
  regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS domain,
  regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/[^/]+/[^/]+') OR regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/([^/]{{25,}}|[^/]*[0-9][^/]*)/?$') AS article
FROM pages""")
def link_keys(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.link_key(u).alias("link_key"), text.domain(u).alias("domain"), text.has_article_path(u).alias("article"))


@query(110, 109, 329, 331, sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(regexp_extract(replace('$' || CAST(event_id * 1000 AS VARCHAR) || ',5%', ',', ''), '(-?[0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS cell,
  '{"type":"' || event_type || '","user":' || CAST(user_id AS VARCHAR) || '}' AS encoded FROM events""")
def json_cells(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.from_json("props", "k long")["k"].alias("k"), text.quantity(F.concat(F.lit("$"), (F.col("event_id") * 1000).cast("string"), F.lit(",5%"))).alias("cell"),
        F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("encoded"),
    )


@query(95, 265, 345, sql="""
SELECT event_id, ((event_id * 1000003 + 1000000000) << 22 >> 22) + 1288834974657 AS ms, CAST(event_id AS BIGINT) > 99 AS newer FROM events""")
def post_times(spark, sf_dir):
    post = F.shiftleft(F.col("event_id") * 1000003 + 1000000000, 22)
    return table(spark, sf_dir, "events").select("event_id", text.snowflake_ms(post).alias("ms"), text.newer_id(F.col("event_id").cast("string"), F.lit("0099")).alias("newer"))


_UTC = "to_timestamp({0}) AT TIME ZONE 'UTC'"


@query(97, 332, 333, 334, 335, 336, 339, sql=f"""
WITH {POSITIONS}
SELECT event_id, CAST(to_timestamp(t) AT TIME ZONE 'Asia/Jerusalem' AS DATE) AS local_day, CAST({_UTC.format('t + 10800')} AS DATE) AS fixed_day, CAST({_UTC.format('t - 7200')} AS DATE) AS night_day,
  CAST(floor((t + 10800) / 10800.0) * 10800 - 10800 AS BIGINT) AS window_3h, CAST(floor((t + 10800) / 3600.0) AS BIGINT) % 24 % 6 = 0 AS six_hour_mark, t - 1704067200 >= 3600 AS due
FROM positions""")
def clock_keys(spark, sf_dir):
    t = F.col("t")
    return positions(spark, sf_dir).select(
        "event_id", clock.local_day(t, "Asia/Jerusalem").alias("local_day"), clock.fixed_day(t).alias("fixed_day"), clock.night_day(t).alias("night_day"),
        clock.window_start(t, 3).cast("long").alias("window_3h"), clock.is_mark(t).alias("six_hour_mark"), clock.due(t, F.lit(1704067200), F.lit(60)).alias("due"),
    )


@query(344, sql=f"""
WITH {POSITIONS}, m AS (SELECT event_id, t, make_timestamp(2024, CAST(event_id % 12 + 1 AS BIGINT), CAST(event_id % 28 + 1 AS BIGINT), CAST(event_id % 24 AS BIGINT), 0, 0) AS same FROM positions),
y AS (SELECT event_id, t, CAST(epoch(same) AS BIGINT) AS s0, CAST(epoch(same + INTERVAL 1 YEAR) AS BIGINT) AS s1, CAST(epoch(same - INTERVAL 1 YEAR) AS BIGINT) AS s_1 FROM m)
SELECT event_id, CASE WHEN s_1 BETWEEN t - 5184000 AND t + 25920000 THEN s_1 WHEN s0 BETWEEN t - 5184000 AND t + 25920000 THEN s0 WHEN s1 BETWEEN t - 5184000 AND t + 25920000 THEN s1 END AS eta FROM y""")
def inferred_dates(spark, sf_dir):
    k = F.col("event_id").cast("int")
    return positions(spark, sf_dir).select(
        "event_id", clock.near_year(k % 12 + 1, k % 28 + 1, k % 24, F.col("t")).alias("eta"),
    )


_KM = "2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin(radians({3} - {1}) / 2), 2))))"
_BRG = "degrees(atan2(sin(radians({3} - {1})) * cos(radians({2})), cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians({3} - {1})))) + 360"


@query(146, 347, 348, 349, 351, 359, sql=f"""
WITH {POSITIONS}, g AS (
  SELECT event_id, lat, lon, speed, {_KM.format('lat', 'lon', '15.0', '43.0')} AS km, fmod({_BRG.format('lat', 'lon', '15.0', '43.0')}, 360) AS brg FROM positions
)
SELECT event_id, round(km, 4) AS km, round(brg, 4) AS bearing, round(abs(fmod(brg - 90 + 540, 360) - 180), 4) AS off_east,
  round(degrees(asin(sin(radians(lat)) * cos(speed / 6371.0) + cos(radians(lat)) * sin(speed / 6371.0) * cos(radians(brg)))), 4) AS moved_lat, km < 700 AS near FROM g""")
def sphere(spark, sf_dir):
    lat, lon, to = F.col("lat"), F.col("lon"), (F.lit(15.0), F.lit(43.0))
    brg = geo.bearing(lat, lon, *to)
    away = geo.km(lat, lon, *to)
    return positions(spark, sf_dir).select(
        "event_id", F.round(away, 4).alias("km"), F.round(brg, 4).alias("bearing"), F.round(geo.angle_between(brg, F.lit(90.0)), 4).alias("off_east"),
        F.round(geo.moved(lat, lon, brg, F.col("speed"))[0], 4).alias("moved_lat"), (away < 700).alias("near"),
    )
