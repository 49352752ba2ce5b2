"""Structured Streaming forms of the engine's stateful operators, each usable on any streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.functions.geo import R


def windowed_counts(stream: DataFrame, at: str, by: str, every: str = "3 hours", late: str = "12 hours") -> DataFrame:
    """Tumbling counts by kind; rows later than the watermark do not count."""
    return stream.withWatermark(at, late).groupBy(F.window(at, every), by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, at: str, key: str, gap: str = "45 minutes", late: str = "12 hours") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, keys: list[str], at: str, keep: str = "2 days") -> DataFrame:
    """Rows whose keys were not met within the time that keys are kept."""
    return stream.withWatermark(at, keep).dropDuplicatesWithinWatermark(keys)


def near_earlier(stream: DataFrame, other: DataFrame, keys: list[str], at: str, within: str, late: str = "1 hour") -> DataFrame:
    """Stream-stream interval join: other rows of the key at most `within` before; state is kept as long as that."""
    l_, r = stream.withWatermark(at, late), other.withWatermark(at, late).withColumnsRenamed({c: f"{c}_r" for c in other.columns})
    on = (F.col(at) >= F.col(f"{at}_r")) & (F.col(at) <= F.col(f"{at}_r") + F.expr(f"interval {within}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"{k}_r"))
    return l_.join(r, on)


_FIX = "key long, t long, lat double, lon double, accepted boolean"
_STATE = "t long, lat double, lon double, ht long, hlat double, hlon double"


def _km(a: float, b: float, c: float, d: float) -> float:
    from math import asin, cos, radians, sin, sqrt

    x, y = sin(radians(c - a) / 2), sin(radians(d - b) / 2)
    return 2 * R * asin(min(1.0, sqrt(x * x + cos(radians(a)) * cos(radians(c)) * y * y)))


def _step(known: tuple | None, fix: tuple[int, float, float]) -> tuple[tuple, bool]:
    """The state after a fix and whether it was accepted: a jump waits until a second fix within 10 km and an hour."""
    t, lat, lon = fix
    if known is None:
        return (t, lat, lon, None, None, None), True
    t0, lat0, lon0, ht, hlat, hlon = known
    away = _km(lat0, lon0, lat, lon)
    jump = away > 20 and away / 1.852 > 60 * max(t - t0, 1) / 3600
    if not jump or (ht is not None and t - ht <= 3600 and _km(hlat, hlon, lat, lon) <= 10):
        return (t, lat, lon, None, None, None), True
    return (t0, lat0, lon0, t, lat, lon), False


def accepted_fixes(stream: DataFrame, late: str = "1 hour", keep_ms: int = 86_400_000) -> DataFrame:
    """Fixes (key, t, lat, lon) with whether they are accepted; a key's state ends when the watermark is a day past its
    last fix."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = tuple(None if pd.isna(x) else x for x in state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t", "lat", "lon"])
        out = []
        for t, lat, lon in zip(rows["t"].tolist(), rows["lat"].tolist(), rows["lon"].tolist()):
            known, ok = _step(known, (t, lat, lon))
            out.append((key[0], t, lat, lon, ok))
        state.update(known)
        state.setTimeoutTimestamp(max(int(known[0]) * 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "t", "lat", "lon", "accepted"])

    own = stream.select("key", "t", "lat", "lon", F.timestamp_seconds("t").alias("at")).withWatermark("at", late)
    return own.groupBy("key").applyInPandasWithState(update, _FIX, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drained(spark: SparkSession, out: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is there and gives its result as a table in the checkpoint folder."""
    import uuid

    from tideline.lineage import shared_dir

    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={0 if mode == 'complete' else n}")

    out.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out").select(*out.columns)
