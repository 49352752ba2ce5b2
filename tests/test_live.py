"""Live state, wait queues and drains: over several runs from one checkpoint, against plain passes over all rows."""

import random
import uuid

import pytest

from tideline.lineage import shared_dir
from tideline.streaming import live

POSITION = "key long, id long, t long, lat double, lon double, feed string, name string, speed double, level double"
BASE = 1_700_000_000


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/live-{uuid.uuid4().hex[:8]}"


def runs(spark, folder, parts, schema, make):
    """Each part as a file of its own, then a run to the end from the same checkpoint; rows of the sink after all."""
    out = None
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        live.drain(out, f"{folder}/out", f"{folder}/checkpoint")
    return [tuple(r) for r in live.taken(spark, f"{folder}/out", out.schema).collect()]


def plain_positions(rows, keep, late, newest):
    out = []
    for key in {r[0] for r in rows}:
        legs = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if not legs or r[2] - legs[-1][-1][2] > keep:
                legs.append([])
            legs[-1].append(r)
            told = [next((x[k] for x in reversed(legs[-1]) if x[k] is not None), None) for k in (6, 7, 8)]
            out.append((key, "seen", *r[2:6], *told))
            last = out[-1]
            legs[-1][-1] = r
        for n, leg in enumerate(legs):
            told = [next((x[k] for x in reversed(leg) if x[k] is not None), None) for k in (6, 7, 8)]
            if n + 1 < len(legs) or leg[-1][2] + keep <= newest - late:
                goes_on = told[1] is not None and told[1] >= 120 and told[2] is not None and told[2] >= 5000
                out.append((key, "ghost" if goes_on else "lost", *leg[-1][2:6], *told))
    return sorted(map(repr, out))


def test_positions_over_three_runs(spark, folder):
    rng = random.Random(3)
    rows = sorted(((rng.randrange(4), i, BASE + rng.randrange(40) * 900, float(i % 7), 1.5, f"f{i % 3}", rng.choice([None, "n"]), rng.choice([None, 50.0, 300.0]), rng.choice([None, 9000.0])) for i in range(160)), key=lambda r: r[2])
    got = runs(spark, folder, [rows[:60], rows[60:61], rows[61:]], POSITION, lambda s: live.live_positions(s, keep=2700, late="1 second"))
    assert sorted(map(repr, got)) == plain_positions(rows, 2700, 1, rows[-1][2])
    assert {r[1] for r in got} == {"seen", "lost", "ghost"}


def test_an_older_row_fills_gaps_only(spark, folder):
    rows = [(1, 1, BASE + 100, 1.0, 1.0, "a", None, 10.0, None), (1, 2, BASE + 50, 9.0, 9.0, "b", "late", 99.0, 7.0)]
    got = runs(spark, folder, [rows[:1], rows[1:]], POSITION, lambda s: live.live_positions(s, keep=600, late="1 hour"))
    assert (1, "seen", BASE + 100, 1.0, 1.0, "a", "late", 10.0, 7.0) in got and len(got) == 2


def test_waiting_over_runs(spark, folder):
    rng = random.Random(4)
    wait, rows = 1800, sorted(((rng.randrange(3), i, BASE + rng.randrange(600) * 30, rng.random() < 0.2) for i in range(300)), key=lambda r: r[2])
    make = lambda s: live.answered(s.filter("not answer"), s.filter("answer"), wait=wait, late="60 seconds")
    got = runs(spark, folder, [rows[:100], rows[100:180], rows[180:]], "key long, id long, t long, answer boolean", make)
    want, newest = [], rows[-1][2]
    for k, i, t, a in rows:
        if not a and t + wait + 1 <= newest - 60:
            first = min(((x[2], x[1]) for x in rows if x[3] and x[0] == k and t <= x[2] <= t + wait), default=(None, None))
            want.append((k, i, t, first[1], first[0]))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(w[3] is None for w in want) and any(w[3] is not None for w in want)


def test_a_drain_ended_between_write_and_commit(spark, folder):
    schema, died = "id long", []
    spark.range(0, 50).coalesce(2).write.parquet(f"{folder}/in")

    def dies(n):
        if not died:
            died.append(n)
            raise RuntimeError("killed")

    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with pytest.raises(Exception):
        live.drain(source(), f"{folder}/out", f"{folder}/checkpoint", after_write=dies)
    assert died == [0]
    spark.range(50, 70).write.mode("append").parquet(f"{folder}/in")
    for _ in range(2):  # the second run finds nothing to take
        live.drain(source(), f"{folder}/out", f"{folder}/checkpoint")
    assert sorted(r.id for r in live.taken(spark, f"{folder}/out", source().schema).collect()) == list(range(70))


def test_one_timer_settles_all_that_is_due():
    import pandas as pd

    class State(dict):
        containsKey, getValue, removeKey, updateValue = dict.__contains__, dict.__getitem__, dict.pop, dict.__setitem__

    class Handle(set):
        registerTimer, deleteTimer = set.add, set.discard
        getMapState, listTimers = (lambda self, *_: State()), (lambda self: list(self))

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 10**9)

    queue, handle = live.WaitQueue(100), Handle()
    queue.init(handle)
    list(queue.handleInputRows((1,), iter([pd.DataFrame([(i, i, i % 50 == 0) for i in range(5000)], columns=["id", "t", "answers"])]), None))
    assert len(handle) == 1  # 5,000 timers, one for each second, before
    out = pd.concat(queue.handleExpiredTimer((1,), Now, None))
    got = {int(t): None if pd.isna(x) else int(x) for t, x in zip(out["t"], out["answer"])}
    assert got == {t: -(-t // 50) * 50 if t <= 4950 else None for t in range(5000) if t % 50}
    assert not queue.items and not queue.answers
