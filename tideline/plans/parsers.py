"""Documents in the formats of feeds, written from the tables, with the gaps and spellings such documents have, and read back
by the parsers of tideline.sources.  Each document holds a month of a series or one row's own items, so that none grows
with the table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions.text import squeeze
from tideline.session import DAILY, REPORTS, daily, reports, table
from tideline.sources import html, tabular


def months(spark, sf_dir):
    """A row a series and month with its points p (day, v) in order."""
    d = daily(spark, sf_dir)
    return d.groupBy("series", F.trunc("day", "MM").alias("month")).agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("p"))


def _points(docs, found, *keys):
    return docs.select(*keys, F.explode(found).alias("x")).select(*keys, F.col("x.d").alias("d"), F.round("x.v", 2).alias("v"))


def _number(v):
    return F.format_number(v, 2)


@query(18, 19, sql=f"WITH {DAILY} SELECT series, day AS d, v FROM daily WHERE day(day) % 7 <> 0")
def csv_series(spark, sf_dir):
    """CSV with its columns in either order, `.` for a missing value and blank lines; points by header."""
    date_first = F.length("series") % 2 == 0
    value = lambda p: F.when(F.day(p["day"]) % 7 == 0, ".").otherwise(p["v"].cast("decimal(18,2)").cast("string"))
    lines = F.transform("p", lambda p: F.when(date_first, F.concat_ws(",", p["day"].cast("string"), F.lit("x"), value(p))).otherwise(F.concat_ws(",", value(p), p["day"].cast("string"))))
    csv = F.concat(F.when(date_first, "observation_date,note,Value\n\n").otherwise("VALUE, observation_date\r\n"), F.array_join(lines, "\n"))
    rows = months(spark, sf_dir).select("series", F.explode(tabular.csv_cells(csv, ["observation_date", "value"])).alias("x"))
    found = rows.select("series", F.try_to_date("x.observation_date", "yyyy-MM-dd").alias("d"), F.col("x.value").try_cast("double").alias("v"))
    return found.filter("d is not null and v is not null")


@query(11, 12, sql=f"""WITH {DAILY}, m AS (SELECT *, count(*) OVER (PARTITION BY series, date_trunc('month', day)) AS total FROM daily)
SELECT series, day AS d, v, CAST(total AS INTEGER) AS total FROM m""")
def table_series(spark, sf_dir):
    """HTML tables with a head row, attributes, entities and thousands separators, and a total above; points and totals."""
    row = lambda p: F.concat(F.lit("<tr class='r'><td>"), p["day"].cast("string"), F.lit("&nbsp;</td><td style=\"x\"><b>"), _number(p["v"]), F.lit("</b></td></tr>\n"))
    page = F.concat(F.lit("<p>Total rows: <b>"), F.size("p").cast("string"), F.lit("</b></p><table><tr><th>Date</th><th>Close</th></tr>"), F.array_join(F.transform("p", row), ""), F.lit("<tr><td>n/a</td><td>-</td></tr></table>"))
    docs = months(spark, sf_dir).select("series", page.alias("page"))
    docs = docs.withColumn("total", F.regexp_extract("page", r"Total rows: <b>([0-9]+)", 1).cast("int"))
    return _points(docs, tabular.table_points(F.col("page")), "series", "total")


@query(13, sql=f"WITH {DAILY} SELECT series, day AS d, v FROM daily WHERE dayofweek(day) = 5")
def weekly_grid(spark, sf_dir):
    """A grid with a row a month, pairs of week's end and value, and empty cells; points."""
    weeks = F.filter("p", lambda p: F.dayofweek(p["day"]) == 6)
    cell = lambda p: F.concat(F.lit("<td>"), F.date_format(p["day"], "MM/dd"), F.lit("</td><td>"), _number(p["v"]), F.lit("</td>"))
    page = F.concat(F.lit("<table><tr><th>Month</th><th>End</th><th>Value</th></tr><tr><td>&nbsp;"), F.date_format("month", "yyyy-MMM"), F.lit("</td>"), F.array_join(F.transform(weeks, cell), ""), F.lit("<td>&nbsp;</td><td>&nbsp;</td></tr></table>"))
    return _points(months(spark, sf_dir), tabular.grid_points(page), "series")


@query(15, sql=f"WITH {DAILY} SELECT series, day AS d, v FROM daily WHERE day(day) % 5 <> 0")
def chart_series(spark, sf_dir):
    """Chart JSON: parallel arrays, an offset that moves late evenings to the next day, nulls where nothing was traded."""
    at = F.transform("p", lambda p: F.unix_seconds(p["day"].cast("timestamp")) - 3600)
    close = F.transform("p", lambda p: F.when(F.day(p["day"]) % 5 != 0, p["v"]))
    return _points(months(spark, sf_dir), tabular.chart_points(F.to_json(F.struct(at.alias("timestamp"), close.alias("close"), F.lit(7200).alias("offset")))), "series")


@query(16, 17, sql=f"WITH {DAILY} SELECT series, day AS d, v FROM daily WHERE day(day) % 6 <> 0")
def bar_series(spark, sf_dir):
    """JSON bars with times and closes as texts, and an HTML table inside a JSON field that says the same."""
    price = lambda p: F.when(F.day(p["day"]) % 6 == 0, "n/a").otherwise(_number(p["v"]))
    bars = F.transform("p", lambda p: F.struct(F.date_format(p["day"], "yyyyMMdd'1630'").alias("tradeTime"), price(p).alias("close")))
    rows = F.transform("p", lambda p: F.concat(F.lit("<tr><td>"), p["day"].cast("string"), F.lit("</td><td>"), price(p), F.lit("</td></tr>")))
    docs = months(spark, sf_dir).select("series", F.to_json(F.struct(bars.alias("bars"), F.array_join(rows, "").alias("html"))).alias("json"))
    one = _points(docs, tabular.bar_points(F.col("json")), "series")
    other = _points(docs, tabular.table_points(F.get_json_object("json", "$.html")), "series")
    return one.intersect(other)


@query(2, 22, sql="""SELECT CAST(event_id AS VARCHAR) AS id, event_type || ' of ' || CAST(user_id AS VARCHAR) AS text, CAST(user_id % 3 AS INTEGER) AS photos FROM events WHERE event_id % 4 <> 3""")
def status_posts(spark, sf_dir):
    """A status list for each event: links in the text, photos and other media, entries without an id."""
    e, k = table(spark, sf_dir, "events"), F.col("user_id") % 3
    media = F.concat(F.array_repeat(F.struct(F.lit("photo").alias("type")), k.cast("int")), F.array(F.struct(F.lit("video").alias("type"))))
    words = F.concat(F.lit("https://t.example/a "), F.col("event_type"), F.lit("  of\n"), F.col("user_id").cast("string"), F.lit(" https://t.example/b?c=d"))
    post = F.struct(F.when(F.col("event_id") % 4 != 3, F.col("event_id").cast("string")).alias("id"), words.alias("text"), media.alias("media"))
    return e.select(F.explode(tabular.posts(F.to_json(F.struct(F.array(post).alias("posts"))))).alias("x")).select("x.id", "x.text", "x.photos")


@query(14, sql="""SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS INTEGER) AS added, '/' || event_type || '/' || strftime(CAST(ts AS DATE), '%Y-%m-%d') AS link FROM events GROUP BY 1, 2""")
def list_additions(spark, sf_dir):
    """Change histories of a list for each kind and day, with entries that add nothing; what was added when."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    note = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " entry has").otherwise(" entries have"), F.lit(" been added"))
    stamp, link = F.concat(F.col("day").cast("string"), F.lit("T09:30:00Z")), F.concat_ws("/", F.lit(""), "event_type", F.col("day").cast("string"))
    history = F.array(F.struct(stamp.alias("at"), note.alias("note"), link.alias("link")), F.struct(stamp.alias("at"), F.lit("Format changed").alias("note"), link.alias("link")))
    found = e.select("event_type", F.explode(tabular.additions(F.to_json(F.struct(F.struct(history.alias("history")).alias("details"))))).alias("x"))
    return found.select("event_type", "x.day", "x.added", "x.link")


@query(7, sql="SELECT page_id, url, 'Result ' || CAST(page_id AS VARCHAR) AS title FROM pages")
def search_results(spark, sf_dir):
    """RSS of search results whose links carry the real address as a parameter."""
    xml = F.concat(
        F.lit("<rss><item><title>Result "), F.col("page_id").cast("string"), F.lit("</title><link>http://search.example/click?id=1&amp;url="), F.url_encode(F.col("url")), F.lit("&amp;c=2</link></item></rss>")
    )
    items = table(spark, sf_dir, "pages").select("page_id", F.explode(html.feed_items(xml)).alias("i"))
    return items.select("page_id", tabular.real_link(F.col("i.link")).alias("url"), "i.title")


@query(8, 23, sql=f"""WITH {REPORTS}, k AS (SELECT source, fp, at_, length(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 2500)) AS n_chars, row_number() OVER (PARTITION BY source ORDER BY at_ DESC, fp) AS k
  FROM reports WHERE at_ > (SELECT max(at_) - 30 * 86400 FROM reports)) SELECT source, fp, at_ AS at, n_chars FROM k WHERE k <= 12""")
def newest_documents(spark, sf_dir):
    """Of each source the twelve newest documents past a watermark, as rows typed from RSS, texts cut to 2,500 characters
    (number and cut are the feature)."""
    r = reports(spark, sf_dir).select("source", "fp", "at", "text")
    since = r.agg((F.max("at") - 30 * 86400).alias("since"))  # one row
    fresh = r.crossJoin(F.broadcast(since)).filter("at > since")
    newest = Window.partitionBy("source").orderBy(F.desc("at"), "fp")
    rows = fresh.withColumn("k", F.row_number().over(newest)).filter("k <= 12")
    xml = F.concat(F.lit("<rss><item><title>"), F.col("fp"), F.lit("</title><pubDate>"), F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate></item></rss>"))
    items = rows.select("source", F.get(html.feed_items(xml), F.lit(0)).alias("i"), F.length(F.left(squeeze(F.col("text")), F.lit(2500))).cast("long").alias("n_chars"))
    return items.select("source", F.col("i.title").alias("fp"), F.unix_timestamp(F.to_timestamp("i.published")).alias("at"), "n_chars")


@query(6, sql="""SELECT page_id, CASE WHEN page_id % 5 = 4 THEN NULL ELSE DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) END AS day FROM pages""")
def page_dates(spark, sf_dir):
    """When a page is from: the first of its metadata, linked data, time element and printed line; null without any."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")).cast("string")
    other = F.lit("2023-06-07")
    marks = [
        F.concat(F.lit("<p>"), other, F.lit('</p><meta property="article:published_time" content="'), day, F.lit('T10:00:00Z">')),
        F.concat(F.lit('<time datetime="'), other, F.lit('"></time>{"datePublished":"'), day, F.lit('T10"}')),
        F.concat(F.lit('<p>2022-02-02</p><time class="t" datetime="'), day, F.lit('">then</time>')),
        F.concat(F.lit("<p>Printed "), day, F.lit("</p>")),
    ]
    mark = F.get(F.array(*marks), (F.col("page_id") % 5).cast("int"))
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"20[0-9]{2}-[01][0-9]-[0-3][0-9]", "")
    return table(spark, sf_dir, "pages").select("page_id", html.page_date(F.concat(body, F.coalesce(mark, F.lit("")))).alias("day"))


@query(21, sql="""SELECT conv_id, turn, md5(trim(regexp_replace(replace(text, '<', ' '), '\\s+', ' ', 'g'))) AS words, CASE WHEN role = 'assistant' THEN md5(trim(regexp_replace(replace(text, '<', ' '), '\\s+', ' ', 'g'))) ELSE md5('') END AS answer FROM conversations""")
def transcripts(spark, sf_dir):
    """Transcript pages, a turn each: what was said, and what was said in answer."""
    page = F.concat(F.lit('<div class="who">'), F.col("role"), F.lit('</div><div class="said">'), F.replace("text", F.lit("<"), F.lit(" ")), F.lit("</div>"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", page.alias("page"))
    return c.select("conv_id", "turn", F.md5(squeeze(tabular.spoken(F.col("page")))).alias("words"), F.md5(squeeze(tabular.spoken(F.col("page"), True))).alias("answer"))
