"""CSV texts, HTML tables and JSON documents to points and rows, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.text import quantity
from tideline.sources.html import table_rows


def csv_cells(csv: Column, names: list[str]) -> Column:
    """Rows of a CSV text as structs of the named columns, found by the header whatever their order; a column that the
    header lacks is null, blank lines are left out."""
    lines = F.filter(F.split(csv, r"\r?\n"), lambda x: F.trim(x) != "")
    header = F.transform(F.split(F.get(lines, F.lit(0)), ","), lambda x: F.upper(F.trim(x)))
    at = {n: F.nullif(F.array_position(header, n.upper()), F.lit(0)) - 1 for n in names}
    return F.transform(
        F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda x: F.struct(*(F.trim(F.get(F.split(x, ","), at[n].cast("int"))).alias(n) for n in names)),
    )


def table_points(html: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """(d, v) of two-column table rows; heads and rows without a date or a number are left out."""
    rows = F.transform(table_rows(html), lambda r: F.struct(F.try_to_date(F.get(r, F.lit(0)), pattern).alias("d"), quantity(F.get(r, F.lit(1))).alias("v")))
    return F.filter(rows, lambda p: p["d"].isNotNull() & p["v"].isNotNull())


def grid_points(html: Column) -> Column:
    """(d, v) of a grid with a row a month (`2024-Jan`) and pairs of cells: end of week (`01/05`) and value; empty pairs are
    left out."""
    def pairs(row: Column) -> Column:
        year = F.regexp_extract(F.get(row, F.lit(0)), r"([0-9]{4})", 1)
        at = F.sequence(F.lit(1), F.greatest(F.size(row) - 2, F.lit(1)), F.lit(2))
        return F.transform(at, lambda i: F.struct(
            F.try_to_date(F.concat_ws("-", year, F.replace(F.get(row, i), F.lit("/"), F.lit("-"))), "yyyy-MM-dd").alias("d"), quantity(F.get(row, i + 1)).alias("v")
        ))

    rows = F.filter(table_rows(html), lambda r: F.size(r) >= 3)
    return F.filter(F.flatten(F.transform(rows, pairs)), lambda p: p["d"].isNotNull() & p["v"].isNotNull())


def chart_points(json: Column) -> Column:
    """(d, v) of chart JSON with parallel arrays of epoch seconds and closes, days by the exchange's offset; gaps dropped."""
    c = F.from_json(json, "timestamp array<long>, close array<double>, offset long")
    both = F.arrays_zip(c["timestamp"].alias("t"), c["close"].alias("v"))
    pts = F.transform(both, lambda p: F.struct(F.timestamp_seconds(p["t"] + F.coalesce(c["offset"], F.lit(0))).cast("date").alias("d"), p["v"].alias("v")))
    return F.filter(pts, lambda p: p["v"].isNotNull() & p["d"].isNotNull())


def bar_points(json: Column) -> Column:
    """(d, v) of JSON with an array of bars, times as yyyymmdd, closes as texts; a later bar of a day takes its place."""
    bars = F.from_json(F.get_json_object(json, "$.bars"), "array<struct<tradeTime:string,close:string>>")
    pts = F.transform(bars, lambda b: F.struct(F.try_to_date(F.left(b["tradeTime"], F.lit(8)), "yyyyMMdd").alias("d"), quantity(b["close"]).alias("v")))
    return F.filter(pts, lambda p: p["d"].isNotNull() & p["v"].isNotNull())


def posts(json: Column) -> Column:
    """Posts of a status list as structs (id, text, photos): links leave the text, media stay as a number."""
    rows = F.from_json(F.get_json_object(json, "$.posts"), "array<struct<id:string,text:string,media:array<struct<type:string>>>>")
    return F.transform(F.filter(rows, lambda p: p["id"].isNotNull()), lambda p: F.struct(
        p["id"].alias("id"), F.trim(F.regexp_replace(F.regexp_replace(p["text"], r"https?://[^\s]+", ""), r"\s+", " ")).alias("text"),
        F.size(F.filter(F.coalesce(p["media"], F.from_json(F.lit("[]"), "array<struct<type:string>>")), lambda m: m["type"] == "photo")).alias("photos"),
    ))


def additions(json: Column) -> Column:
    """A list's change history as structs (day, added, link); entries that add nothing are left out."""
    rows = F.from_json(F.get_json_object(json, "$.details.history"), "array<struct<at:string,note:string,link:string>>")
    rows = F.transform(rows, lambda r: F.struct(F.try_to_date(F.left(r["at"], F.lit(10))).alias("day"), F.regexp_extract(r["note"], r"([0-9]+) (?:entry|entries)", 1).try_cast("int").alias("added"), r["link"].alias("link")))
    return F.filter(rows, lambda r: r["added"] > 0)


def real_link(link: Column) -> Column:
    """The target of a search result's link, out of its url parameter."""
    inner = F.regexp_extract(link, r"[?&](?:amp;)?url=([^&]+)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(link)


def spoken(page: Column, answers_only: bool = False) -> Column:
    """Words of a transcript page: the contents of its `said` blocks, or only of those under another speaker's question."""
    who = r'(?s)<div class="who">([^<]*)</div><div class="said">(.*?)</div>'
    names, words = F.regexp_extract_all(page, F.lit(who), F.lit(1)), F.regexp_extract_all(page, F.lit(who), F.lit(2))
    both = F.arrays_zip(names.alias("who"), words.alias("said"))
    return F.array_join(F.transform(F.filter(both, lambda x: x["who"] == "assistant") if answers_only else both, lambda x: x["said"]), " ")
