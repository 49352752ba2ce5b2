"""Ordered folds against a plain pass over the sorted rows, whatever the blocks and the order of the input."""

import json
import os
import random
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from tideline.operators import merging, ordered_fold


def updates(n=700, seed=5):
    rng = random.Random(seed)
    return [(rng.choice([None, "a", "hot", "hot", "hot", "b"]), t, rng.choice([None, -1, 60, rng.randrange(2000), rng.randrange(200), 10**12 * (t % 2)]), f"i{rng.randrange(3)}", rng.random() < 0.8, rng.random() < 0.9) for t in range(n)]


def plain_guard(rows, unofficial=False):
    """The rules in their own words, on sorted rows."""
    standing, out = {}, []
    for k, t, v, by, official, stated in sorted(rows, key=lambda r: r[1]):
        was = standing.get(k)
        ok = v is not None and v >= 0 and stated and (official or unofficial)
        if ok and was:
            if v < was[0]:
                ok = by == was[1] or not (was[2] or unofficial)
            if was[0] > 50 and v > 10 * was[0]:
                ok = False
        if ok:
            standing[k] = (v, by, official)
        now = standing.get(k)
        out.append((k, t, ok, now and now[0], now and now[1]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("block_rows, unofficial", [(40, False), (10_000, True)])
def test_guarded_figures(spark, block_rows, unofficial):
    rows = updates()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, value long, issuer string, official boolean, stated boolean").repartition(3)
    out = ordered_fold.running_figures(df, ["k"], ["t"], block_rows=block_rows, unofficial_count=unofficial)
    assert sorted(repr((r.k, r.t, r.accepted, r.standing, r.standing_issuer)) for r in out.collect()) == plain_guard(rows, unofficial)


def test_a_fold_that_never_forgets(spark):
    """A running sum depends on every row before: states pass through all blocks of a key."""
    df = spark.createDataFrame([(k, t, t * 7 % 5) for k in ("x", "y") for t in range(60)], "k string, t long, v long")
    add = lambda state, row: ((state or 0) + row["v"], {"sofar": (state or 0) + row["v"]})
    out = ordered_fold.fold_in_order(df, ["k"], ["t"], add, "sofar long", block_rows=12)
    assert sorted((r.k, r.t, r.sofar) for r in out.collect()) == [(k, t, sum(x * 7 % 5 for x in range(t + 1))) for k in ("x", "y") for t in range(60)]
    ends = {r.k: json.loads(r.s) for r in out.filter("_state is not null").groupBy("k").agg(F.max_by("_state", "t").alias("s")).collect()}
    more = spark.createDataFrame([("x", 100, 1), ("z", 100, 1)], "k string, t long, v long")
    begun = spark.createDataFrame([(k, json.dumps(v)) for k, v in ends.items()], "k string, _state string")
    assert {(r.k, r.sofar) for r in ordered_fold.fold_in_order(more, ["k"], ["t"], add, "sofar long", initial=begun).collect()} == {("x", ends["x"] + 1), ("z", 1)}


def test_an_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([("x", 1, 5, "i", True, True)] * 3, "k string, t long, value long, issuer string, official boolean, stated boolean")
    assert [r.standing for r in ordered_fold.running_figures(df, ["k"], ["t"]).collect()] == [5] * 3
    assert ordered_fold.running_figures(df.limit(0), ["k"], ["t"]).collect() == []


SEAS = [("north", "strait"), ("strait", "south")]


def brute_homes(cards, within):
    """Homes as lists of their members; what a home tells is worked out anew from its members each time."""
    homes, out = {}, {}

    def told(members):
        first = {f: next((m[f] for m in members if m[f]), None) for f in ("sea", "name", "cause")}
        kinds = [m["kind"] for m in members if m["kind"]]
        first["kind"] = next((k for k in kinds if k != "ship"), kinds[0] if kinds else None)
        return first

    def fits(x, y):
        if x["name"] and y["name"]:
            return x["name"] == y["name"]
        if not x["sea"] or not y["sea"]:
            return x["kind"] == y["kind"] and x["kind"] not in (None, "", "ship") and bool(x["cause"]) and x["cause"] == y["cause"]
        near = x["sea"] == y["sea"] or (x["sea"], y["sea"]) in SEAS or (y["sea"], x["sea"]) in SEAS
        clash = (x["cause"] and y["cause"] and x["cause"] != y["cause"]) or (x["kind"] and y["kind"] and x["kind"] != y["kind"] and "ship" not in (x["kind"], y["kind"]))
        return near and not clash

    for c in sorted(cards, key=lambda c: (c["t"], c["id"])):
        own = homes.setdefault(c["g"], [])
        open_ = [m for m in own if c["t"] - m[0]["t"] <= within]
        mine = next((m for m in open_ if fits(told(m), c)), None) if c["sea"] or c["name"] or c["cause"] else None
        if mine is None:
            mine = [c]
            if c["sea"] or c["name"] or c["cause"]:
                own.append(mine)
        else:
            mine.append(c)
        best = max(m["rank"] for m in mine)
        lead = next(m["source"] for m in mine if m["rank"] == best)
        now = told(mine)
        out[c["id"]] = (mine[0]["id"], len(mine) > 1, lead, {m["source"] for m in mine} - {lead}, now["kind"], now["sea"], now["name"], now["cause"])
    return out


@pytest.mark.parametrize("block_rows", [30, 5_000])
def test_merging_fold(spark, block_rows):
    rng = random.Random(8)
    cards = [{"id": i, "g": rng.choice("abbb"), "t": i * 300 // 4 * 4, "source": f"s{rng.randrange(6)}", "rank": rng.randrange(3), "kind": rng.choice(["ship", "tanker", "carrier", "", None]),
              "sea": rng.choice(["north", "strait", "south", "ocean", None, ""]), "name": rng.choice([None, None, "", "mv1", "mv2", "mv3"]), "cause": rng.choice([None, "mine", "drone"])} for i in range(400)]
    rng.shuffle(cards)
    df = spark.createDataFrame([tuple(c.values()) for c in cards], "id long, g string, t long, source string, rank int, kind string, sea string, name string, cause string")
    out = merging.merge_cards(df, ["g"], within=4 * 3600, neighbours=frozenset(SEAS), block_rows=block_rows)
    got = {r.id: (r.home, r.joined, r.lead, set(r.also), r.kind_now, r.sea_now, r.name_now, r.cause_now) for r in out.collect()}
    want = brute_homes(cards, 4 * 3600)
    assert got.keys() == want.keys()
    assert {k: (a, b) for k, a in got.items() if a != (b := want[k])} == {}
    assert sum(v[1] for v in want.values()) > 100
    assert merging.merge_cards(df.limit(0), ["g"], within=10).collect() == []


def km(a, b):
    from math import asin, cos, radians, sin, sqrt

    s = sin(radians(b["lat"] - a["lat"]) / 2) ** 2 + cos(radians(a["lat"])) * cos(radians(b["lat"])) * sin(radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 6371.0 * asin(min(1.0, sqrt(s)))


def test_pins(spark):
    rng = random.Random(14)
    pins = [{"name": rng.choice(["x", "x", "y"]), "id": i, "day": rng.choice([None, *range(6), *range(6)]), "t": rng.choice([None, rng.randrange(20000)]), "lat": rng.choice([10.0, 10.05, 10.2, None]), "lon": rng.choice([20.0, 20.05]),
             "link": rng.choice([None, "u", "v"]), "source": rng.choice(["s", "t", "r", None]), "actor": rng.choice([None, "", "a", "b"])} for i in range(220)]
    df = spark.createDataFrame([tuple(p.values()) for p in pins], "name string, id long, day int, t long, lat double, lon double, link string, source string, actor string").repartition(3)
    got = {r.id: (r.pin, r.joined, r.lead, set(r.also), r.actor_now) for r in merging.merge_pins(df, "name", block_rows=25).collect()}
    score = lambda p: (4 if p["t"] is not None else 0) + (2 if p["actor"] else 0)
    open_, want = [], {}

    def view(members):
        """A pin by its members in order: its lead, whose place and time count, and the first actor named by lead or others."""
        lead, actor = members[0], members[0]["actor"] or ""
        for m in members[1:]:
            better = score(m) > score(lead) if m is not lead else False
            actor = (m["actor"] or actor) if better else (actor or m["actor"] or "")
            lead = m if better else lead
        return lead, actor

    for p in sorted(pins, key=lambda p: (p["day"] is not None, p["day"] or 0, p["id"])):
        mine = None
        if None not in (p["day"], p["lat"], p["lon"]):
            for m in open_:
                lead, actor = view(m)
                if m[0]["name"] != p["name"] or p["day"] - lead["day"] > 1 or (actor and p["actor"] and actor != p["actor"]) or (lead["t"] is not None and p["t"] is not None and abs(lead["t"] - p["t"]) > 10800):
                    continue
                if (lead["day"] == p["day"] and km(lead, p) < 15) or (lead["day"] != p["day"] and p["link"] and lead["link"] == p["link"] and km(lead, p) < 10):
                    mine = m
                    break
            if mine is None:
                open_.append([p])
            else:
                mine.append(p)
        lead, actor = view(mine or [p])
        want[p["id"]] = ((mine or [p])[0]["id"], mine is not None, lead["id"], actor or None)
    assert {k: (v[0], v[1], v[2], v[4]) for k, v in got.items()} == want and sum(v[1] for v in want.values()) > 30
    assert all(s is not None for v in got.values() for s in v[3])


def test_a_state_is_handed_to_the_first_row_of_a_block_only(spark, monkeypatch):
    """With the state on every row, a task would hold it as many times as it has rows."""
    given, folder = [], ordered_fold._folder

    def watched(*a):
        run = folder(*a)
        log = tempfile.mkdtemp()
        given.append(log)

        def seen(batches):
            def each():
                for batch in batches:
                    with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                        json.dump([[r["_block"], r["_given"]] for r in batch.to_pylist()], f)
                    yield batch
            return run(each())

        return seen

    monkeypatch.setattr(ordered_fold, "_folder", watched)
    df = spark.createDataFrame([("a" if i < 300 else "b", i, i % 7) for i in range(400)], "k string, t int, v int")
    out = ordered_fold.fold_in_order(df, ["k"], ["t"], lambda state, row: ((state or 0) + row["v"], {"sofar": (state or 0) + row["v"]}), "sofar long", block_rows=50)
    want = {(i, sum(j % 7 for j in range(0 if i < 300 else 300, i + 1))) for i in range(400)}
    assert {(r.t, r.sofar) for r in out.collect()} == want
    again = [[x for name in os.listdir(log) for x in json.load(open(f"{log}/{name}"))] for log in given[1:]]
    assert again and all(sum(g is not None for _, g in rows) <= len({b for b, _ in rows}) for rows in again)
    assert any(g is not None for rows in again for _, g in rows)
