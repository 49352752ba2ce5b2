"""Incidents read off headlines, and the first earlier report against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import incidents as I
from tideline.operators.incidents import first_earlier, ship_keys, toll_keys


def test_each_figure_counts_once(spark):
    cases = {
        "Strike kills 8 and wounds 6": ([], [8], [6]), "Nine killed and 16 injured": ([], [9], [16]), "Attack kills and wounds 14": ([14], [], []), "20 people killed and wounded": ([20], [], []),
        "Death and injury toll rises to 20": ([20], [], []), "Raid wounding two citizens": ([], [], [2]), "Fire kills a civilian shepherd": ([], [1], []),
        "5 killed and 5 dead, 5 hurt": ([], [5], [5]), "12345 killed": ([], [], []), "0 killed": ([], [], []), "": ([], [], []), None: ([], [], []), "x" * 50_000 + " 4 killed": ([], [4], []),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: (r.x["total"], r.x["dead"], r.x["hurt"]) for r in df.select("t", I.toll_of(F.col("t")).alias("x")).collect()}
    assert got == cases


def meets(x, y):
    sums = lambda v: set(v["total"]) | ({v["dead"][0] + v["hurt"][0]} if v["dead"] and v["hurt"] else set())
    return any(n == m or (min(n, m) >= 3 and abs(n - m) == 1) for n in x["dead"] for m in y["dead"]) or (not x["dead"] and not y["dead"] and bool(set(x["hurt"]) & set(y["hurt"]))) or bool(set(x["total"]) & sums(y)) or bool(set(y["total"]) & sums(x))


@pytest.mark.parametrize("within", [50, 400])
def test_first_toll(spark, within):
    rng = random.Random(within)
    some = lambda: [rng.randrange(1, 7) for _ in range(rng.choice([0, 0, 1, 2]))]
    rows = [(i, rng.choice([None, rng.randrange(1000)]) if i < 6 else rng.randrange(1000), rng.choice(["a", "a", "b", None]), list(dict.fromkeys(some())), list(dict.fromkeys(some())), list(dict.fromkeys(some()))) for i in range(250)]
    df = spark.createDataFrame(rows, "id int, t long, place string, total array<int>, dead array<int>, hurt array<int>")
    out = first_earlier(df, "id", "t", *toll_keys(F.col("place"), F.struct("total", "dead", "hurt")), within=within)
    got = {r.id: (r.first_at, r["first"]) for r in out.collect()}
    want = {}
    for i, t, p, *f in rows:
        own = dict(zip(("total", "dead", "hurt"), f))
        early = [(u, j) for j, u, q, *g in rows if t is not None and u is not None and p is not None and p == q and t - within <= u and (u, j) < (t, i) and meets(dict(zip(("total", "dead", "hurt"), g)), own)]
        if early:
            want[i] = min(early)
    assert got == want and len(want) > 30


def test_first_ship(spark):
    rng = random.Random(2)
    near = {"red": ["bab"], "bab": ["red", "aden"], "aden": ["bab"]}
    rows = [(i, rng.randrange(600), rng.choice(["ship", "tanker", "carrier", None]), rng.choice(["red", "bab", "aden", "gulf", None]), rng.choice([None, None, "m", "n"]), rng.choice([None, "mine", "boat"])) for i in range(250)]

    def same(x, y):
        (k, s, n, c), (k2, s2, n2, c2) = x, y
        if n and n2:
            return n == n2
        if not s or not s2:
            return bool(k) and k == k2 and k != "ship" and bool(c) and c == c2
        return (s == s2 or s2 in near.get(s, [])) and (not c or not c2 or c == c2) and (k == k2 or "ship" in (k, k2))

    rows = [r for r in rows if r[2]]
    df = spark.createDataFrame(rows, "id int, t long, kind string, sea string, name string, cause string")
    out = first_earlier(df, "id", "t", *ship_keys(F.struct("kind", "sea", "name", "cause"), near), within=90)
    want = {}
    for i, t, *x in rows:
        early = [(u, j) for j, u, *y in rows if t - 90 <= u and (u, j) < (t, i) and same(y, x)]
        if early:
            want[i] = min(early)
    assert {r.id: (r.first_at, r["first"]) for r in out.collect()} == want and len(want) > 50
    assert first_earlier(df.limit(0), "id", "t", *ship_keys(F.struct("kind", "sea", "name", "cause"), near), within=90).count() == 0


def test_money(spark):
    cases = {"Iraq lost $60 billion": "iraq 60 billion", "USD 1.5bn for Iran and Iraq": "iran 1.5 billion", "$60 at Iraq": None, "$60 billion": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.k for r in df.select("t", I.money_key(F.col("t"), ["Iraq", "Iran"]).alias("k")).collect()} == cases


def test_a_text_is_read_once_for_each_pattern(spark):
    plan = spark.range(1).select(I.toll_of(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") < 100  # each of the ten patterns finds and takes out; 590 where later ones read anew


def test_reports_are_read_once(spark):
    df = spark.range(9).select("id", F.col("id").alias("t"), F.array(F.lit("a"), F.lit(None)).alias("k"))
    found = first_earlier(df, "id", "t", F.col("k"), F.col("k"), within=3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 9") == 1  # four times, and as often dealt out, with a pass for each kind of key
    assert sorted(map(tuple, found.collect())) == [(i, max(0, i - 3), max(0, i - 3)) for i in range(1, 9)]
