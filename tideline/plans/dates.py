"""Queries of dates in texts: ranges, other calendars, and days long ago."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import clock, dates
from tideline.session import table

_DAY = "CAST(o_orderdate AS DATE)"
_RANGES = f"""CASE o_orderkey % 7 WHEN 0 THEN strftime({_DAY}, '%Y-%m-%d') WHEN 1 THEN strftime({_DAY}, '%Y-%m-%d') || '..28' WHEN 2 THEN strftime({_DAY}, '%Y-%m-%d') || '/29'
  WHEN 3 THEN strftime({_DAY}, '%Y-%m-%d') || '; 06-11' WHEN 4 THEN strftime({_DAY}, '%Y-%m') WHEN 5 THEN strftime({_DAY}, '%Y-%m-%d') || '..12-30;07;1999-02-03; 04-05' ELSE '03-04; soon; ' || strftime({_DAY}, '%Y-%m') || ';;05' END"""
_GROUP = r"nullif(regexp_extract({0}, '^(?:(\d{{4}})-)?(\d{{2}})(?:-(\d{{2}}))?(?:(?:\.\.|/)(?:(\d{{2}})-)?(\d{{2}}))?$', {1}), '')"


@query(425, sql=f"""WITH s AS (SELECT o_orderkey, list_transform(string_split({_RANGES}, ';'), lambda p: trim(p)) AS parts FROM orders),
l AS (SELECT o_orderkey, i - 1 AS i, parts[i] AS p, parts[1:i] AS upto FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM s)),
g AS (SELECT *, {_GROUP.format('p', 2)} AS m, {_GROUP.format('p', 3)} AS d, {_GROUP.format('p', 4)} AS m2, {_GROUP.format('p', 5)} AS d2,
  coalesce(list_extract(list_filter(list_transform(upto, lambda x: {_GROUP.format('x', 1)}), lambda y: y IS NOT NULL), -1), '1994') AS y FROM l)
SELECT o_orderkey, i, CASE WHEN m IS NOT NULL THEN concat_ws('-', y, m, d) END AS begins, CASE WHEN m IS NULL THEN NULL WHEN d IS NULL OR d2 IS NULL THEN concat_ws('-', y, m, d) ELSE concat_ws('-', y, coalesce(m2, m), d2) END AS ends,
  CASE WHEN m IS NOT NULL THEN d IS NULL END AS month_only FROM g""")
def ranges_in_text(spark, sf_dir):
    """Order days written as ranges, read back part by part; parts of another form are null."""
    o, day = table(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    full, month, k = F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-MM"), F.col("o_orderkey") % 7
    said = (
        F.when(k == 0, full).when(k == 1, F.concat(full, F.lit("..28"))).when(k == 2, F.concat(full, F.lit("/29"))).when(k == 3, F.concat(full, F.lit("; 06-11"))).when(k == 4, month)
        .when(k == 5, F.concat(full, F.lit("..12-30;07;1999-02-03; 04-05"))).otherwise(F.concat(F.lit("03-04; soon; "), month, F.lit(";;05")))
    )
    r = o.select("o_orderkey", F.posexplode(dates.date_ranges(said, "1994")).alias("i", "r"))
    return r.select("o_orderkey", F.col("i").cast("long").alias("i"), F.col("r.from").alias("begins"), F.col("r.to").alias("ends"), F.col("r.month_only").alias("month_only"))


# The Umm al-Qura calendar of the time that orders cover, for the SQL: day number of the first day, lengths of months by
# year (fixed values; a test holds them against the table that the engine reads from the platform).
HIJRI_FROM = 8218
HIJRI_MONTHS = {
    1413: (29, 30, 29, 29, 30, 29, 30, 30, 30, 29, 30, 29),
    1414: (30, 29, 30, 29, 29, 30, 29, 30, 30, 29, 30, 30),
    1415: (29, 30, 29, 30, 29, 29, 30, 29, 30, 29, 30, 30),
    1416: (30, 29, 30, 29, 30, 29, 29, 30, 29, 30, 29, 30),
    1417: (30, 29, 30, 30, 29, 29, 30, 29, 30, 29, 30, 29),
    1418: (30, 29, 30, 30, 29, 30, 29, 30, 29, 30, 29, 30),
    1419: (29, 30, 29, 30, 29, 30, 29, 30, 30, 30, 29, 29),
    1420: (29, 30, 29, 29, 30, 29, 30, 30, 30, 30, 29, 30),
    1421: (29, 29, 30, 29, 29, 29, 30, 30, 30, 30, 29, 30),
    1422: (30, 29, 29, 30, 29, 29, 29, 30, 30, 30, 29, 30),
}


def _hijri_sql() -> str:
    start, rows = HIJRI_FROM, []
    for y, lengths in HIJRI_MONTHS.items():
        for m, n in enumerate(lengths, 1):
            rows.append(f"({y}, {m}, {start}, {n})")
            start += n
    return "hijri AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(y, m, s, n))"


def _listed(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_PERSIAN_SQL = """days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), pn AS (SELECT day, date_diff('day', DATE '1970-01-01', day) + 1075195 AS n FROM days),
pr AS (SELECT day, n, n % 12053 AS r, n % 12053 % 1461 AS q FROM pn), pk AS (SELECT *, CASE WHEN q > 365 THEN (q - 1) % 365 ELSE q END AS k FROM pr),
persian AS (SELECT day, CAST(-1595 + 33 * (n // 12053) + 4 * (r // 1461) + CASE WHEN q > 365 THEN (q - 1) // 365 ELSE 0 END AS INTEGER) AS y,
  CAST(CASE WHEN k < 186 THEN 1 + k // 31 ELSE 7 + (k - 186) // 30 END AS INTEGER) AS m, CAST(CASE WHEN k < 186 THEN 1 + k % 31 ELSE 1 + (k - 186) % 30 END AS INTEGER) AS d FROM pk)"""
_PLAIN = "CAST(day(day) AS VARCHAR) || ' ' || " + _listed(dates.GREGORIAN) + "[month(day)] || ' ' || CAST(year(day) AS VARCHAR)"
_SHORT = "CASE WHEN p.m > 6 AND p.d = 30 AND p.m < 12 THEN 31 ELSE p.d END"


@query(342, 343, sql=f"""WITH {_hijri_sql()}, {_PERSIAN_SQL}, h AS (
  SELECT day, hijri.y, hijri.m, date_diff('day', DATE '1970-01-01', day) - s + 1 AS d FROM days JOIN hijri ON date_diff('day', DATE '1970-01-01', day) >= s AND date_diff('day', DATE '1970-01-01', day) < s + n
), told AS (
  SELECT o_orderkey, o_orderkey % 5 AS k, p.day, {_PLAIN.replace("day(day)", "day(p.day)").replace("month(day)", "month(p.day)").replace("year(day)", "year(p.day)")} AS plain,
    CAST({_SHORT} AS VARCHAR) || ' ' || {_listed(dates.PERSIAN)}[p.m] AS pd, CAST(p.y AS VARCHAR) AS py, CAST(h.d AS VARCHAR) || ' ' || {_listed(dates.HIJRI)}[h.m] AS hd, CAST(h.y AS VARCHAR) AS hy,
    {_SHORT} <> p.d AS wrong FROM orders JOIN persian p ON p.day = CAST(o_orderdate AS DATE) JOIN h ON h.day = p.day
)
SELECT o_orderkey, CASE k WHEN 0 THEN 'signed on ' || CASE WHEN wrong THEN pd || ' ' || py ELSE plain END || '.' WHEN 1 THEN 'signed on 8 October 1996 and sent, as of ' || CASE WHEN wrong THEN pd || ' ' || py ELSE plain END
    WHEN 2 THEN plain || ' it was; 31 Esfand 1375 is none' WHEN 3 THEN 'since ' || CASE WHEN wrong THEN pd ELSE plain END || ' and ' || plain || ', Mehr News says' ELSE 'paid at once' END AS western,
  CASE k WHEN 0 THEN CASE WHEN wrong THEN 0 ELSE 1 END WHEN 1 THEN CASE WHEN wrong THEN 0 ELSE 1 END WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN wrong THEN 1 ELSE 2 END ELSE 0 END
    + CASE WHEN k = 1 THEN 1 ELSE 0 END AS n_dated FROM told""")
def western_texts(spark, sf_dir):
    """Texts that date orders in other calendars, with the dates as days of ours."""
    days = dates.calendar_days(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    hijri = days.filter("cal = 'hijri'").select("day", F.col("y").alias("hy"), F.col("m").alias("hm"), F.col("d").alias("hd"))
    o = o.withColumn("p", clock.persian(F.col("day"))).join(hijri, "day")
    name = lambda names, m: F.element_at(F.array(*(F.lit(n) for n in names)), m)
    d = F.when((F.col("p.m") > 6) & (F.col("p.d") == 30) & (F.col("p.m") < 12), 31).otherwise(F.col("p.d"))  # a day that the month lacks
    pd, hd = F.concat_ws(" ", d, name(dates.PERSIAN, F.col("p.m"))), F.concat_ws(" ", "hd", name(dates.HIJRI, F.col("hm")))
    k = F.col("o_orderkey") % 5
    said = (
        F.when(k == 0, F.concat(F.lit("signed on "), pd, F.lit(" "), "p.y", F.lit("."))).when(k == 1, F.concat(F.lit("signed on 16th Mehr (8 October 1996) and sent, as of "), pd, F.lit(" "), "p.y"))
        .when(k == 2, F.concat(hd, F.lit(" "), "hy", F.lit(" it was; 31 Esfand 1375 is none"))).when(k == 3, F.concat(F.lit("since "), pd, F.lit(" and "), hd, F.lit(", Mehr News says"))).otherwise("paid at once")
    )
    out = dates.with_western_dates(o.select("o_orderkey", "day", said.alias("t")), "o_orderkey", "t", "day", days)
    return out.select("o_orderkey", "western", F.size(F.filter("found", lambda f: f["day"].isNotNull())).alias("n_dated"))


@query(346, sql=f"""WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS at_, CAST(o_orderdate AS DATE) - CAST(o_custkey % 400 - 5 AS INTEGER) AS then_, o_orderkey % 4 AS k FROM orders),
d AS (SELECT *, CASE WHEN k = 3 THEN NULL WHEN k = 2 THEN try_cast(CAST(year(at_) AS VARCHAR) || '-02-30' AS DATE) ELSE try_cast(strftime(at_, '%Y') || strftime(then_, '-%m-%d') AS DATE) END AS same,
  CASE WHEN k < 2 THEN try_cast(CAST(year(at_) - 1 AS VARCHAR) || strftime(then_, '-%m-%d') AS DATE) END AS before FROM t)
SELECT o_orderkey, CASE WHEN same > at_ + 2 THEN before ELSE same END AS told, coalesce(date_diff('day', CASE WHEN same > at_ + 2 THEN before ELSE same END, at_) >= 2, FALSE) AS long_ago FROM d""")
def days_told(spark, sf_dir):
    """Texts that date themselves without a year, and whether that is long before the order's own day."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("at"), F.date_sub(F.to_date("o_orderdate"), (F.col("o_custkey") % 400 - 5).cast("int")).alias("then"))
    month, k = F.date_format("then", "MMMM"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.concat(F.lit("hit on "), F.dayofmonth("then"), F.lit(" "), month)).when(k == 1, F.concat(F.lit("Hit on "), F.upper(month), F.lit(" "), F.dayofmonth("then"), F.lit("th again"))).when(k == 2, "told on 30 February").otherwise("upon 3 May")
    return o.select("o_orderkey", dates.told_day(said, F.col("at")).alias("told"), dates.long_ago(said, F.col("at")).alias("long_ago"))


@query(340, 341, sql=f"""WITH {_hijri_sql()}, {_PERSIAN_SQL}
SELECT p.day, p.y, p.m, p.d, p.day AS back, h.y AS hijri_y, h.m AS hijri_m, CAST(date_diff('day', DATE '1970-01-01', p.day) - h.s + 1 AS INTEGER) AS hijri_d
FROM persian p JOIN hijri h ON date_diff('day', DATE '1970-01-01', p.day) >= h.s AND date_diff('day', DATE '1970-01-01', p.day) < h.s + h.n""")
def calendars(spark, sf_dir):
    """Order days in the Persian calendar, and back again, and in the Umm al-Qura calendar by its table of days."""
    p = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("p", clock.persian(F.col("day")))
    hijri = dates.calendar_days(spark).filter("cal = 'hijri'").select("day", F.col("y").alias("hijri_y"), F.col("m").alias("hijri_m"), F.col("d").alias("hijri_d"))
    return p.select("day", "p.*", clock.from_persian(F.col("p.y"), F.col("p.m"), F.col("p.d")).alias("back")).join(hijri, "day")
