"""Pages and feeds to rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import text
from tideline.session import table
from tideline.sources import html

_CODE = r"regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"


def _plain(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for name, char in (("&nbsp;", " "), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(1, 24, 25, sql=rf"""
WITH c AS (SELECT page_id, html, {_CODE} AS h FROM pages), b AS (SELECT *, regexp_extract(h, '(?s)<article[^>]*>(.*?)</article>', 1) AS a FROM c),
p AS (SELECT page_id, html, list_transform(regexp_extract_all(CASE WHEN a <> '' THEN a ELSE h END, '(?s)<p[^>]*>(.*?)(?:</p>|<p>|$)', 1), lambda x: {_plain('x')}) AS parts FROM b),
t AS (SELECT page_id, html, trim(regexp_replace(array_to_string(parts, ' '), '\s+', ' ', 'g')) AS body FROM p)
SELECT page_id, {_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, length(body) AS n_chars, md5(body) AS body_md5 FROM t""")
def articles(spark, sf_dir):
    """Title and whole article text of every page."""
    p = table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"), html.article(F.col("html")).alias("body"))
    return p.select("page_id", "title", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("body_md5"))


@query(5, 9, 4, sql=rf"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a [^>]*href="([^"]*)"[^>]*>.*?</a>', 0)) AS a FROM pages),
l AS (SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, {_plain("regexp_extract(a, '(?s)>(.*)</a>', 1)")} AS label FROM a)
SELECT page_id, href, arg_max(label, (length(label), label)) AS label FROM l GROUP BY page_id, href""")
def page_links(spark, sf_dir):
    return html.links(table(spark, sf_dir, "pages"), "page_id", "html")


@query(10, sql="""
SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS paragraphs, CAST(len(regexp_extract_all(html, '<li[ >]')) AS INTEGER) AS items, CAST(len(regexp_extract_all(html, '<div[ >]')) AS INTEGER) AS blocks FROM pages""")
def page_counts(spark, sf_dir):
    """Counts of parts of a page."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", *(F.regexp_count(h, F.lit(f"<{t}[ >]")).alias(n) for t, n in (("p", "paragraphs"), ("li", "items"), ("div", "blocks"))))


@query(3, 4, sql="""
SELECT event_id, 'No. ' || CAST(event_id AS VARCHAR) AS title, 'https://example.com/' || event_type || '/' || CAST(user_id AS VARCHAR) AS link, CAST(event_id * 60 + 1704067200 AS BIGINT) AS at FROM events""")
def feed_rows(spark, sf_dir):
    """Items of feeds that Spark writes from events, read back by the feed parser."""
    e = table(spark, sf_dir, "events")
    xml = F.concat(
        F.lit("<rss><channel><item><title><![CDATA[No. "), F.col("event_id").cast("string"), F.lit("]]></title><link>https://example.com/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"),
        F.lit("</link><pubDate>"), F.date_format(F.timestamp_seconds(F.col("event_id") * 60 + 1704067200), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate></item></channel></rss>"),
    )
    items = e.select("event_id", F.explode(html.feed_items(xml)).alias("i"))
    return items.select("event_id", "i.title", "i.link", F.unix_timestamp(F.to_timestamp("i.published")).alias("at"))


@query(61, sql=r"""
SELECT doc_id, translate(regexp_replace(text, 'é', 'إ', 'g'), 'أإآٱ', 'اااا') <> text AS folded, length(translate(text, 'éèêçñóáíúäöüß', 'eeecnoaiuaous')) AS n FROM documents""")
def folded_letters(spark, sf_dir):
    d = F.regexp_replace("text", "é", "إ")
    plain = F.translate("text", "éèêçñóáíúäöüß", "eeecnoaiuaous")
    return table(spark, sf_dir, "documents").select("doc_id", (text.fold_arabic(d) != F.col("text")).alias("folded"), F.length(plain).cast("long").alias("n"))
