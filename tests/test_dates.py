"""Dates in texts: the grammar's cases, the calendar table, and texts rewritten."""

import datetime

from pyspark.sql import functions as F

from tideline.functions import dates
from tideline.plans.dates import HIJRI_FROM, HIJRI_MONTHS


def test_ranges(spark):
    cases = {
        "2026-03-07..12": [("2026-03-07", "2026-03-12", False)], "2026-03-23/24": [("2026-03-23", "2026-03-24", False)], "2026-03": [("2026-03", "2026-03", True)],
        "2026-03-01; 2025-04-06": [("2026-03-01", "2026-03-01", False), ("2025-04-06", "2025-04-06", False)], "2026-03-20..04-03; 06-11": [("2026-03-20", "2026-04-03", False), ("2026-06-11", "2026-06-11", False)],
        "06-11": [("2024-06-11", "2024-06-11", False)], "soon; 07": [None, ("2024-07", "2024-07", True)], "": [None], None: None, "2026-3-1": [None], "2026-03-07..": [None],
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r.c: r.r and [x and tuple(x) for x in r.r] for r in df.select("c", dates.date_ranges(F.col("c"), "2024").alias("r")).collect()}
    assert got == cases


def test_the_table_of_days(spark):
    days = dates.calendar_days(spark, 1413, 1422)
    hijri = days.filter("cal = 'hijri'").groupBy("y", "m").agg(F.count("*").alias("n"), F.min(F.unix_date("day")).alias("s")).orderBy("y", "m").collect()
    assert [r.n for r in hijri] == [n for y in HIJRI_MONTHS for n in HIJRI_MONTHS[y]] and hijri[0].s == HIJRI_FROM
    known = {("hijri", 1420, 9, 1): datetime.date(1999, 12, 9), ("persian", 1378, 10, 11): datetime.date(2000, 1, 1), ("persian", 1375, 12, 30): datetime.date(1997, 3, 20)}
    got = {(r.cal, r.y, r.m, r.d): r.day for r in days.collect()}
    assert {k: got[k] for k in known} == known and len(set(got)) == days.count() and ("persian", 1374, 12, 30) not in got


def test_western_dates(spark):
    rows = [
        (1, "on Thursday 11 Dey 1378 and 1 Ramadan 1420.", "on Thursday 1 January 2000 and 9 December 1999.", 2), (2, "7th Mehr (8 October 1996), Mehr News", "8 October 1996, Mehr News", 1),
        (3, "30 Esfand 1374 is none", "30 Esfand 1374 is none", 0), (4, "12 Dey, 13 Bahman", "2 January 2000, 2 February 1999", 2), (5, None, None, None), (6, "", "", 0), (7, "x" * 100_000 + " 11 Dey 1378", "x" * 100_000 + " 1 January 2000", 1),
    ]
    df = spark.createDataFrame([(k, t, datetime.date(2000, 1, 5), "clash") for k, t, *_ in rows], "id int, t string, day date, y string")
    out = dates.with_western_dates(df, "id", "t", "day", dates.calendar_days(spark, 1413, 1422))
    got = {r.id: (r.western, None if r.found is None else sum(f.day is not None for f in r.found)) for r in out.collect()}
    assert got == {k: (w, n) for k, _, w, n in rows} and out.columns == ["id", "t", "day", "y", "western", "found"]


def test_long_ago(spark):
    at = datetime.date(2024, 1, 3)
    rows = [("on 6 October it sank", datetime.date(2023, 10, 6), True), ("On January 2nd", datetime.date(2024, 1, 2), False), ("on 1 January", datetime.date(2024, 1, 1), True), ("on 5 January", datetime.date(2024, 1, 5), False),
            ("on 6 JANUARY", datetime.date(2023, 1, 6), True), ("on 31 June", None, False), ("upon 3 May", None, False), (None, None, False), ("", None, False), ("on 99 May", None, False)]
    df = spark.createDataFrame([(t, at) for t, *_ in rows], "t string, d date")
    assert [tuple(r) for r in df.select(dates.told_day(F.col("t"), F.col("d")), dates.long_ago(F.col("t"), F.col("d"))).collect()] == [(a, b) for _, a, b in rows]
