"""Streaming queries over the event files, drained and read back; batch SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.session import POSITIONS, seconds
from tideline.streaming import live, stateful


def events(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    # A pattern, since a stream's plain path has to be a folder.
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")
    return rows.withColumn("at", F.timestamp_seconds(seconds(F.col("ts"))))


@query(365, 378, 381, sql=f"""WITH {POSITIONS} SELECT CAST(floor(t / 10800.0) AS BIGINT) * 10800 AS w, event_type, count(*) AS n FROM positions GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    out = stateful.drained(spark, stateful.windowed_counts(events(spark, sf_dir), "at", "event_type"), "complete", "windows")
    return out.select(F.unix_timestamp("window.start").alias("w"), "event_type", "n")


@query(369, 370, 371, 364, sql="""SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events""")
def stream_first_seen(spark, sf_dir):
    """Keys met for the first time; every event day is within the time that keys are kept in this run."""
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts")).withWatermark("at", "60 days")
    seen = e.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"])
    return stateful.drained(spark, seen.select("user_id", "event_type", "day"), "append", "seen")


@query(372, 373, 376)
def stream_positions(spark, sf_dir):
    """Fixes accepted or held back as jumps, with state per key."""
    e = events(spark, sf_dir)
    p = e.select(
        F.col("user_id").alias("key"), seconds(F.col("ts")).alias("t"), (F.col("user_id") % 100 - 50 + F.col("event_id") % 40 / 20).alias("lat"),
        (F.col("user_id") * 7 % 300 - 150 + F.col("event_id") % 60 / 20).alias("lon"),
    )
    return stateful.drained(spark, stateful.accepted_fixes(p), "append", "fixes")


_KEEP, _LATE = 6 * 3600, 3600


@query(372, 373, sql=f"""WITH {POSITIONS}, p AS (
  SELECT *, 'f' || CAST(event_id % 3 AS VARCHAR) AS feed, CASE WHEN event_id % 3 = 0 THEN 'n' || CAST(event_id % 10 AS VARCHAR) END AS name,
    CASE WHEN event_id % 3 = 1 THEN CAST(event_id % 40 * 10 AS DOUBLE) END AS knots, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 97 * 100 AS DOUBLE) END AS level FROM positions
), parted AS (
  SELECT *, sum(CASE WHEN gap > {_KEEP} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t, event_id) AS leg
  FROM (SELECT *, t - lag(t) OVER (PARTITION BY key ORDER BY t, event_id) AS gap FROM p)
), filled AS (
  SELECT key, t, event_id, leg, lat, lon, feed, last_value(name IGNORE NULLS) OVER w AS name, last_value(knots IGNORE NULLS) OVER w AS speed, last_value(level IGNORE NULLS) OVER w AS level,
    row_number() OVER (PARTITION BY key, leg ORDER BY t DESC, event_id DESC) = 1 AS last_, max(leg) OVER (PARTITION BY key) > leg AS heard_again, (SELECT max(t) FROM p) AS newest
  FROM parted WINDOW w AS (PARTITION BY key, leg ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT key, 'seen' AS kind, t, lat, lon, feed, name, speed, level FROM filled
UNION ALL SELECT key, CASE WHEN speed >= 120 AND level >= 5000 THEN 'ghost' ELSE 'lost' END, t, lat, lon, feed, name, speed, level FROM filled WHERE last_ AND (heard_again OR t + {_KEEP} <= newest - {_LATE})""")
def live_positions(spark, sf_dir):
    """Positions merged over feeds; keys that fall silent come out once more, as ghosts if under way."""
    e, known = events(spark, sf_dir), live.feed_facts(F.col("event_id"))
    p = e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("id"), seconds(F.col("ts")).alias("t"), (F.col("user_id") % 100 - 50 + F.col("event_id") % 40 / 20).alias("lat"),
        (F.col("user_id") * 7 % 300 - 150 + F.col("event_id") % 60 / 20).alias("lon"), *(c.alias(k) for k, c in known.items()),
    )
    return stateful.drained(spark, live.live_positions(p, keep=_KEEP, late=f"{_LATE} seconds"), "append", "live")


_WAIT = 3 * 3600


@query(379, sql=f"""WITH {POSITIONS}, items AS (SELECT key, event_id AS id, t FROM positions WHERE event_id % 5 <> 0), answers AS (SELECT key, event_id AS id, t FROM positions WHERE event_id % 5 = 0),
  met AS (SELECT i.key, i.id, i.t, min(struct_pack(t := a.t, id := a.id)) AS first FROM items i LEFT JOIN answers a ON a.key = i.key AND a.t BETWEEN i.t AND i.t + {_WAIT} GROUP BY 1, 2, 3)
  SELECT key, id, t, first.id AS answer, first.t AS answered_at FROM met WHERE t + {_WAIT} + 1 <= (SELECT max(t) FROM positions) - {_LATE}""")
def wait_queue(spark, sf_dir):
    """Events that wait up to three hours for their key's next answer; each comes out once, answered or not."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), seconds(F.col("ts")).alias("t"))
    return stateful.drained(spark, live.answered(e.filter("id % 5 <> 0"), e.filter("id % 5 = 0"), wait=_WAIT, late=f"{_LATE} seconds"), "append", "waited")


@query(42, sql="SELECT event_id, user_id, event_type FROM events")
def drained_queue(spark, sf_dir):
    """Every event taken off its queue once, by a sink that repeats a batch without a trace."""
    from uuid import uuid4

    from tideline.lineage import shared_dir

    root, e = f"{shared_dir(spark)}/taken-{uuid4().hex[:12]}", events(spark, sf_dir).select("event_id", "user_id", "event_type")
    live.drain(e, f"{root}/out", f"{root}/checkpoint")
    return live.taken(spark, f"{root}/out", e.schema)
