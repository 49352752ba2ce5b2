"""The session settings that the engine expects, and its view of the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a stream of short reports: fp, at (epoch seconds), source, desk, summary (first line), text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("fp"), "doc_id", (F.lit(1704067200) + F.col("doc_id") * 420).alias("at"),
        "source", F.col("lang").alias("desk"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("summary"), "text",
    )


REPORTS = """reports AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS fp, doc_id, 1704067200 + doc_id * 420 AS at_, source, lang AS desk,
  split_part(text, chr(10), 1) AS summary, text FROM documents)"""


def micros(ts) -> Column:
    """Microseconds of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def seconds(ts) -> Column:
    return F.floor(micros(ts) / 1_000_000)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as position fixes: key, t (epoch seconds), lat, lon, speed."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("key"), seconds(F.col("ts")).alias("t"),
        (F.col("user_id") % 100 - 50 + F.col("event_id") % 40 / 20).alias("lat"), (F.col("user_id") * 7 % 300 - 150 + F.col("event_id") % 60 / 20).alias("lon"),
        (F.col("event_id") % 25).cast("double").alias("speed"), "event_type", "value",
    )


POSITIONS = """positions AS (SELECT event_id, user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id % 100 - 50 + CAST(event_id % 40 AS DOUBLE) / 20 AS lat,
  user_id * 7 % 300 - 150 + CAST(event_id % 60 AS DOUBLE) / 20 AS lon, CAST(event_id % 25 AS DOUBLE) AS speed, event_type, value FROM events)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a daily series: series (priority), day, v."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.max("o_totalprice"), 2).alias("v"))


DAILY = """daily AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, round(max(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)"""
