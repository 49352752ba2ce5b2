"""Keyed live state with timers that emit, wait queues with a deadline, and drains that survive a restart.

The processors need the RocksDB state store (with_timers sets it for the session) and event-time watermarks: a timer fires
when the watermark passes it, in the batch after, whether or not that batch has rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _told(x) -> bool:
    return x is not None and x == x  # null, or NaN as pandas has it


def _in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> list[dict]:
    """A key's rows of one micro-batch; how many those are is the trigger's (maxFilesPerTrigger) to bound."""
    rows = pd.concat(list(batches)).sort_values(by, kind="stable")
    names = list(rows.columns)
    return [dict(zip(names, r)) for r in zip(*(rows[c].tolist() for c in names))]


# Live positions

_POSITION = "t long, lat double, lon double, feed string"
_FACTS = "name string, speed double, level double"
LIVE = "key long, kind string, t long, lat double, lon double, feed string, name string, speed double, level double"


class LivePositions(StatefulProcessor):
    """Positions of a key from several feeds: the newest wins, facts that it lacks come from the others, older or newer.
    A key that no feed has heard of for `keep` seconds is lost: its last row comes out once more, as a ghost if it was
    under way (fast and high enough to go on), and its state goes. Heard again, it begins anew."""

    def __init__(self, keep: int, least_speed: float, least_level: float):
        self.keep, self.least_speed, self.least_level = keep, least_speed, least_level

    def init(self, handle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", _POSITION)
        self.facts = handle.getValueState("facts", _FACTS)

    def _row(self, key: int, kind: str, position: tuple, facts: tuple) -> tuple:
        return (key, kind, *position, *facts)

    def _gone(self, key: int, position: tuple, facts: tuple) -> tuple:
        goes_on = _told(facts[1]) and facts[1] >= self.least_speed and _told(facts[2]) and facts[2] >= self.least_level
        return self._row(key, "ghost" if goes_on else "lost", position, facts)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LIVE.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        position = tuple(self.position.get()) if self.position.exists() else None
        facts, out = tuple(self.facts.get()) if self.facts.exists() else (None, None, None), []
        was = position and position[0]
        for r in _in_order(rows, ["t", "id"]):
            own = tuple(r[c] if _told(r[c]) else None for c in ("name", "speed", "level"))
            if position is not None and r["t"] - position[0] > self.keep:  # lost before it was heard again
                out.append(self._gone(key[0], position, facts))
                position, facts = None, (None, None, None)
            if position is None or r["t"] >= position[0]:
                position, facts = (int(r["t"]), float(r["lat"]), float(r["lon"]), r["feed"]), tuple(b if a is None else a for a, b in zip(own, facts))
            else:
                facts = tuple(a if _told(a) else b for a, b in zip(facts, own))
            out.append(self._row(key[0], "seen", position, facts))
        self.position.update(position)
        self.facts.update(facts)
        if position[0] != was:
            if was is not None:
                self.handle.deleteTimer((was + self.keep) * 1000)
            self.handle.registerTimer((position[0] + self.keep) * 1000)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        position, facts = tuple(self.position.get()), tuple(self.facts.get())
        self.position.clear()
        self.facts.clear()
        yield self._frame([self._gone(key[0], position, facts)])

    def close(self) -> None:
        pass


def live_positions(stream: DataFrame, *, late: str = "1 hour", keep: int = 6 * 3600, least_speed: float = 120.0, least_level: float = 5000.0) -> DataFrame:
    """stream (key, id, t seconds, lat, lon, feed, name, speed, level) as rows `seen`, `lost` and `ghost`."""
    with_timers(stream.sparkSession)
    own = stream.select("key", "id", "t", "lat", "lon", "feed", "name", "speed", "level", F.timestamp_seconds("t").alias("at")).withWatermark("at", late)
    return own.groupBy("key").transformWithStateInPandas(LivePositions(keep, least_speed, least_level), LIVE, "Append", "EventTime")


# Wait queues

WAITED = "key long, id long, t long, answer long, answered_at long"


class WaitQueue(StatefulProcessor):
    """Items of a key that wait for its next answer: the first one from an item's time to its deadline answers it. Each item
    comes out once, with its answer or without, when the watermark passes the deadline and no earlier answer can come.

    Items and answers are kept by stretches as long as the wait, so an item's answer is in its own stretch or the next. A key
    has one timer, for its earliest deadline, and then settles all that is due, in order of time: state is read and written
    once a stretch, not once an item."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "stretch long", "t array<long>, id array<long>")
        self.answers = handle.getMapState("answers", "stretch long", "t array<long>, id array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size, new = self.wait + 1, ({}, {})
        for r in _in_order(rows, ["t", "id"]):
            new[bool(r["answers"])].setdefault(int(r["t"]) // size, []).append((int(r["t"]), int(r["id"])))
        for state, own in zip((self.items, self.answers), new):
            for stretch, some in own.items():
                self._keep(state, stretch, self._kept(state, stretch) + some)
        due = [min(own) * size + self.wait + 1 for own in new if own]  # not after the earliest deadline
        timers = list(self.handle.listTimers())
        if not timers or min(due) * 1000 < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(min(due) * 1000)
        yield from ()

    def _kept(self, state, stretch: int) -> list[tuple[int, int]]:
        if not state.containsKey((stretch,)):
            return []
        t, ids = state.getValue((stretch,))
        return list(zip(map(int, t), map(int, ids)))

    def _keep(self, state, stretch: int, some: list[tuple[int, int]]) -> None:
        state.updateValue((stretch,), ([t for t, _ in some], [i for _, i in some]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        size, over = self.wait + 1, timerValues.getCurrentWatermarkInMs() // 1000 - self.wait - 1  # items up to that second are due
        known, out, left = {}, [], []
        for stretch in sorted(int(k[0]) for k in self.items.keys()):
            if stretch * size > over:
                left.append(stretch * size)
                continue
            known = {s: known[s] if s in known else sorted(self._kept(self.answers, s)) for s in (stretch, stretch + 1)}
            answers, waiting = known[stretch] + known[stretch + 1], []
            for t, id_ in sorted(self._kept(self.items, stretch)):
                if t > over:
                    waiting.append((t, id_))
                    continue
                at = bisect_left(answers, (t,))
                first = answers[at] if at < len(answers) and answers[at][0] <= t + self.wait else (None, None)
                out.append((key[0], id_, t, first[1], first[0]))
            if waiting:
                left.append(waiting[0][0])
                self._keep(self.items, stretch, waiting)
            else:
                self.items.removeKey((stretch,))
        for stretch in [int(k[0]) for k in self.answers.keys()]:
            if (stretch + 1) * size - 1 <= over:  # no item can ask for these any more
                self.answers.removeKey((stretch,))
            else:
                left.append((stretch + 1) * size - 1)
        if left:
            self.handle.registerTimer((max(min(left), over + 1) + self.wait + 1) * 1000)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WAITED.split(", ")]).astype("Int64")

    def close(self) -> None:
        pass


def answered(items: DataFrame, answers: DataFrame, *, wait: int = 3 * 3600, late: str = "1 hour") -> DataFrame:
    """items and answers (key, id, t) as one row an item (key, id, t, answer, answered_at): the earliest answer of its key
    from t to t + wait, the least id of equal times; nulls where none came. An item comes out when the watermark is past its
    deadline, so late answers within the watermark's delay still count."""
    with_timers(items.sparkSession)
    both = items.select("key", "id", "t", F.lit(False).alias("answers")).unionByName(answers.select("key", "id", "t", F.lit(True).alias("answers")))
    own = both.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    return own.groupBy("key").transformWithStateInPandas(WaitQueue(wait), WAITED, "Append", "EventTime")


# Drains


def drain(stream: DataFrame, path: str, checkpoint: str, *, after_write=None):
    """Moves all that is there into the folder `path`, each row once: a micro-batch writes its own folder, over what an
    earlier try of the same batch has left, so a run that ends between write and commit repeats the batch without a trace.
    after_write(n) is called between the two. Read the result with taken()."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if after_write is not None:
            after_write(n)

    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def taken(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*(F.col(f"`{f.name}`") for f in schema))


def feed_facts(id_: Column) -> dict[str, Column]:
    """Which facts a row's feed tells: names from the first, speed from the second, levels from both others."""
    return {
        "feed": F.concat(F.lit("f"), id_ % 3), "name": F.when(id_ % 3 == 0, F.concat(F.lit("n"), id_ % 10)),
        "speed": F.when(id_ % 3 == 1, (id_ % 40 * 10).cast("double")), "level": F.when(id_ % 3 != 0, (id_ % 97 * 100).cast("double")),
    }
