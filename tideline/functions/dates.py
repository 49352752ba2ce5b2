"""Dates in texts: ranges with carried years, dates of the Persian and the Umm al-Qura calendar, and how long ago one is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.clock import persian

#: Month names as they are written in A-Z (fixed values).
PERSIAN = ("Farvardin", "Ordibehesht", "Khordad", "Tir", "Mordad", "Shahrivar", "Mehr", "Aban", "Azar", "Dey", "Bahman", "Esfand")
HIJRI = ("Muharram", "Safar", "Rabi al-Awwal", "Rabi al-Thani", "Jumada al-Ula", "Jumada al-Akhira", "Rajab", "Shaaban", "Ramadan", "Shawwal", "Dhu al-Qadah", "Dhu al-Hijjah")
GREGORIAN = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

_RANGE = r"^(?:(\d{4})-)?(\d{2})(?:-(\d{2}))?(?:(?:\.\.|/)(?:(\d{2})-)?(\d{2}))?$"


def date_ranges(c: Column, year: str) -> Column:
    """[{from, to, month_only}] of parts like 2026-03-07..12, 2026-03-23/24, 2026-03, 2026-03-20..04-03; 06-11, parted by
    semicolons: a part without a year has that of the part before it, the first one `year`. A part of another form is null
    and carries nothing; a null text has no parts."""
    group = lambda p, k: F.nullif(F.regexp_extract(p, _RANGE, k), F.lit(""))

    def ranged(p: Column, y: Column) -> Column:
        month, day, month2, day2 = (group(p, k) for k in (2, 3, 4, 5))
        begin = F.concat_ws("-", y, month, day)
        end = F.when(day.isNull() | day2.isNull(), begin).otherwise(F.concat_ws("-", y, F.coalesce(month2, month), day2))
        return F.when(month.isNotNull(), F.struct(begin.alias("from"), end.alias("to"), day.isNull().alias("month_only")))

    kind = "array<struct<from:string,to:string,month_only:boolean>>"
    start = F.struct(F.lit(year).alias("y"), F.array().cast(kind).alias("out"))

    def step(s: Column, p: Column) -> Column:
        y = F.coalesce(group(p, 1), s["y"])
        return F.struct(y.alias("y"), F.concat(s["out"], F.array(ranged(p, y)).cast(kind)).alias("out"))

    parts = F.transform(F.split(c, ";"), lambda p: F.trim(p))
    return F.aggregate(parts, start, step, lambda s: s["out"])


def calendar_days(spark: SparkSession, first: int = 1380, last: int = 1500) -> DataFrame:
    """(cal, y, m, d, day): every day of the Hijri years first to last by the Umm al-Qura tables of the Java platform, and
    the days of the Persian calendar of the same time. A few ten thousand rows, whatever the data."""
    of = spark.sparkContext._jvm.java.time.chrono.HijrahDate.of
    months = [(y, m, of(y, m, 1).toEpochDay()) for y in range(first, last + 1) for m in range(1, 13)]
    starts = [*(s for _, _, s in months[1:]), of(last + 1, 1, 1).toEpochDay()]
    rows = spark.createDataFrame([(y, m, s, e) for (y, m, s), e in zip(months, starts)], "y int, m int, s long, e long")
    hijri = rows.select(F.lit("hijri").alias("cal"), "y", "m", F.posexplode(F.sequence("s", F.col("e") - 1)).alias("k", "n"))
    hijri = hijri.select("cal", "y", "m", (F.col("k") + 1).alias("d"), F.date_from_unix_date(F.col("n").cast("int")).alias("day"))
    days = hijri.select("day", persian(F.col("day")).alias("p"))
    return hijri.unionByName(days.select(F.lit("persian").alias("cal"), "p.y", "p.m", "p.d", "day"))


def _names() -> str:
    return "|".join((*PERSIAN, *HIJRI))


#: A day, a month of either calendar, perhaps a year and the day as it is told in brackets.
CALENDAR_DATE = rf"\b\d{{1,2}}(?:st|nd|rd|th)? (?:{_names()})\b(?: 1[345]\d\d\b)?(?: \(\d{{1,2}} [A-Z][a-z]+ \d{{4}}\))?"


def with_western_dates(texts: DataFrame, key: str, text: str, at: str, days: DataFrame) -> DataFrame:
    """texts with `western`, the text with every date of the Persian or Hijri calendar as a day of ours, and `found`, what was
    found: [{text, cal, day}]. A date without a year is the latest one whose month has begun by the day `at`; a day in
    brackets behind a date is kept instead of it; a day that its month lacks stays as it is written (day null).

    key must be unique. Dates are rows while they meet the table of days by year, month and day; a null text stays null."""
    parts = F.split(F.regexp_replace(text, f"({CALENDAR_DATE})", "\u0001$1\u0002"), "\u0002")
    own = [F.col(key).alias("_key"), F.col(at).alias("_at")]
    rows = texts.select(*own, F.posexplode(parts).alias("i", "p")).withColumn("raw", F.when(F.contains("p", F.lit("\u0001")), F.split_part("p", F.lit("\u0001"), F.lit(2))))
    number = {n: k + 1 for names in (PERSIAN, HIJRI) for k, n in enumerate(names)}
    month_of = F.create_map(*(F.lit(x) for n, k in number.items() for x in (n, k)))
    name = F.regexp_extract("raw", f"({_names()})", 1)
    told = rows.select(
        "_key", "_at", "i", "p", "raw", F.when(name.isin(*PERSIAN), "persian").otherwise("hijri").alias("cal"), F.element_at(month_of, name).alias("m"),
        F.regexp_extract("raw", r"^\d+", 0).try_cast("int").alias("d"), F.regexp_extract("raw", r" (1[345]\d\d)\b", 1).try_cast("int").alias("y"),
        F.nullif(F.regexp_extract("raw", r"\((.*)\)", 1), F.lit("")).alias("given"),
    )
    now = days.select("cal", F.col("day").alias("_at"), F.col("y").alias("ny"), F.col("m").alias("nm"))
    dated = told.filter("raw is not null").join(now, ["cal", "_at"], "left").withColumn("y", F.coalesce("y", F.when(F.col("m") <= F.col("nm"), F.col("ny")).otherwise(F.col("ny") - 1)))
    dated = dated.join(days.select("cal", "y", "m", "d", "day"), ["cal", "y", "m", "d"], "left")
    plain = F.concat(F.dayofmonth("day"), F.lit(" "), F.element_at(F.array(*(F.lit(x) for x in GREGORIAN)), F.month("day")), F.lit(" "), F.year("day"))
    new = F.concat(F.split_part("p", F.lit("\u0001"), F.lit(1)), F.coalesce("given", plain, "raw"))
    both = dated.select("_key", "i", new.alias("p"), F.struct(F.col("raw").alias("text"), "cal", "day").alias("f")).unionByName(told.filter("raw is null").select("_key", "i", "p"), allowMissingColumns=True)
    listed = both.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("i", "p", "f"))).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda x: x["p"]), "")
    found = F.filter(F.transform("_l", lambda x: x["f"]), lambda f: f.isNotNull())
    return texts.join(listed.select("_key", joined.alias("western"), found.alias("found")), F.col(key) == F.col("_key"), "left").drop("_key")


def told_day(text: Column, at: Column) -> Column:
    """The day that a text dates itself on ("on 6 October", "on October 6th") at the day `at`: of that year, or of the year
    before if that is more than two days ahead. Null if it does not, or if there is no such day."""
    months = "|".join(GREGORIAN)
    first, second = rf"(?i)\bon (\d{{1,2}})(?:st|nd|rd|th)? ({months})\b", rf"(?i)\bon ({months}) (\d{{1,2}})(?:st|nd|rd|th)?\b"
    day = F.coalesce(F.nullif(F.regexp_extract(text, first, 1), F.lit("")), F.regexp_extract(text, second, 2)).try_cast("int")
    name = F.initcap(F.coalesce(F.nullif(F.regexp_extract(text, first, 2), F.lit("")), F.regexp_extract(text, second, 1)))
    month = F.array_position(F.array(*(F.lit(x) for x in GREGORIAN)), name).cast("int")
    of = lambda y: F.to_date(F.try_make_timestamp(y, month, day, F.lit(0), F.lit(0), F.lit(0)))
    return F.when(month > 0, F.when(of(F.year(at)) > F.date_add(at, 2), of(F.year(at) - 1)).otherwise(of(F.year(at))))


def long_ago(text: Column, at: Column, days: int = 2) -> Column:
    """Does a text date what it tells `days` or more before the day `at`?"""
    return F.coalesce(F.date_diff(at, told_day(text, at)) >= days, F.lit(False))
