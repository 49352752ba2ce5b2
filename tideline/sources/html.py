"""Web pages, feeds and listings to rows, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import decode_entities, squeeze


def without_code(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")


def title(html: Column) -> Column:
    return decode_entities(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1))


def blocks(html: Column, tag: str) -> Column:
    """Contents of all elements of a tag that do not nest, in order."""
    return F.regexp_extract_all(without_code(html), F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))


def article(html: Column) -> Column:
    """The longest of the article element and the page, as text of its paragraphs."""
    inner = F.regexp_extract(without_code(html), r"(?s)<article[^>]*>(.*?)</article>", 1)
    body = F.when(inner != "", inner).otherwise(without_code(html))
    parts = F.regexp_extract_all(body, F.lit(r"(?s)<p[^>]*>(.*?)(?:</p>|<p>|$)"), F.lit(1))
    return squeeze(F.array_join(F.transform(parts, decode_entities), " "))


def lead(text: Column, most: int = 500) -> Column:
    """The beginning of an article up to a sentence end within `most` characters."""
    cut = F.left(text, F.lit(most))
    whole = F.regexp_extract(cut, r"(?s)^(.*[.!?])(\s|$)", 1)
    return F.when(F.length(text) <= most, text).when(whole != "", whole).otherwise(cut)


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href, label): anchors of a page, the longest label of each link."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?s)<a [^>]*href="([^"]*)"[^>]*>.*?</a>'), F.lit(0))
    each = pages.select(key, F.explode(found).alias("a")).select(
        key, F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), decode_entities(F.regexp_extract("a", r"(?s)>(.*)</a>", 1)).alias("label")
    )
    return each.groupBy(key, "href").agg(F.max(F.struct(F.length("label").alias("n"), "label")).alias("b")).select(key, "href", F.col("b.label").alias("label"))


def page_date(html: Column) -> Column:
    """First date among meta, time elements and printed text, in that order."""
    day = r"(20[0-9]{2}-[01][0-9]-[0-3][0-9])"
    tries = [rf'property="article:published_time" content="{day}', rf'"datePublished":"{day}', rf'<time[^>]*datetime="{day}', day]
    return F.coalesce(*(F.try_to_date(F.regexp_extract(html, t, 1), "yyyy-MM-dd") for t in tries))


def table_rows(html: Column) -> Column:
    """Cells of the rows of the tables of a page."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), decode_entities))


ITEM = "title string, link string, pubDate string, description string"


def feed_items(xml: Column) -> Column:
    """RSS items or Atom entries or sitemap entries of one document, as structs of the fields of ITEM."""
    def field(item: Column, *tags: str) -> Column:
        got = [F.nullif(F.regexp_extract(item, rf"(?s)<{t}[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{t}>", 1), F.lit("")) for t in tags]
        return F.coalesce(*got)

    items = F.regexp_extract_all(xml, F.lit(r"(?s)<(item|entry|url)[ >].*?</\1>"), F.lit(0))
    return F.transform(
        items,
        lambda i: F.struct(
            decode_entities(field(i, "title", "news:title")).alias("title"), F.coalesce(field(i, "link", "loc"), F.nullif(F.regexp_extract(i, r'<link[^>]*href="([^"]*)"', 1), F.lit(""))).alias("link"),
            field(i, "pubDate", "published", "updated", "lastmod", "news:publication_date").alias("published"), decode_entities(field(i, "description", "summary")).alias("description"),
        ),
    )


def zipped_points(json: Column, times: str, values: str) -> Column:
    """Chart JSON with parallel arrays of epoch seconds and values, as structs (d, v), gaps dropped."""
    t, v = F.from_json(F.get_json_object(json, times), "array<long>"), F.from_json(F.get_json_object(json, values), "array<double>")
    pts = F.transform(F.arrays_zip(t.alias("t"), v.alias("v")), lambda p: F.struct(F.timestamp_seconds(p["t"]).cast("date").alias("d"), p["v"].alias("v")))
    return F.filter(pts, lambda p: p["v"].isNotNull())
