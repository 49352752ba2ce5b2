import random
import subprocess
import sys
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from tideline.functions import clock, geo, sets, text
from tideline.operators import fold, joins, merging, search, store
from tideline.operators.rules import Rule, first_match, labels, score
from tideline.streaming import stateful


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_greedy_homes_are_not_components(spark):
    # b joins a; c matches b only, so c is a home of its own; d joins the first of a and c.
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")], "early string, late string")
    assert sorted(map(tuple, fold.greedy_homes(pairs).collect())) == [("a", "b"), ("a", "d"), ("c", "d")]


def test_greedy_homes_brute_force(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)})
    home, want = {}, set()
    for x in range(60):
        near = [a for a, b in pairs if b == x and home.get(a)]
        home[x] = not near
        want |= {(a, x) for a in near}
    got = fold.greedy_homes(spark.createDataFrame(pairs, "early long, late long"))
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("block_rows", [500_000, 150])
def test_greedy_homes_of_a_long_chain(spark, block_rows):
    # 300 dependent windows: each even report is a home only because the odd one before it is a copy.
    chain = [(f"r{i:03}", f"r{i + 1:03}") for i in range(600)]
    got = fold.greedy_homes(spark.createDataFrame(chain, "early string, late string"), block_rows=block_rows)
    assert {tuple(r) for r in got.collect()} == {p for p in chain if int(p[0][1:]) % 2 == 0}


def test_greedy_homes_with_times_against_the_order_of_keys(spark):
    chain = [(600 - i, 599 - i) for i in range(600)]
    times = spark.createDataFrame([(k, 600 - k) for k in range(601)], "k long, at long")
    got = fold.greedy_homes(spark.createDataFrame(chain, "early long, late long"), times, block_rows=250)
    assert {tuple(r) for r in got.collect()} == {p for p in chain if p[0] % 2 == 0}


def test_jaccard_pairs_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), i * 10, rng.sample("abcdefghij", rng.randint(0, 6))) for i in range(80)]
    items = spark.createDataFrame(rows, "k long, block string, t long, w array<string>")
    got = {(r.early, r.late) for r in fold.jaccard_pairs(items, key="k", block=["block"], at="t", words=F.col("w"), least=0.4, within=200).collect()}
    want = {
        (a[0], b[0]) for a in rows for b in rows
        if a[1] == b[1] and a[0] < b[0] and b[2] - a[2] <= 200 and set(a[3]) | set(b[3]) and len(set(a[3]) & set(b[3])) / len(set(a[3]) | set(b[3])) >= 0.4
    }
    assert got == want


def test_near_brute_force_over_the_date_line(spark):
    rng = random.Random(7)
    pts = [(i, rng.uniform(-50, 50), rng.choice([rng.uniform(178, 180), rng.uniform(-180, -178)])) for i in range(60)]

    def km(a, b, c, d):
        x, y = sin(radians(c - a) / 2), sin(radians(d - b) / 2)
        return 2 * 6371 * asin(sqrt(x * x + cos(radians(a)) * cos(radians(c)) * y * y))

    p = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(r.id, r.id_r) for r in joins.near(p, p, 300).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if km(a[1], a[2], b[1], b[2]) <= 300}


def test_as_of_strict_and_within(spark):
    left = spark.createDataFrame([("k", 10), ("k", 20), ("q", 5)], "key string, t long")
    right = spark.createDataFrame([("k", 10, "x"), ("k", 3, "w")], "key string, t long, v string")
    got = {(r.key, r.t): r.v_asof for r in joins.as_of(left, right, ["key"], "t", "v").collect()}
    assert got == {("k", 10): "x", ("k", 20): "x", ("q", 5): None}
    got = {(r.key, r.t): r.v_asof for r in joins.as_of(left, right, ["key"], "t", "v", strict=True, within=8).collect()}
    assert got == {("k", 10): "w", ("k", 20): None, ("q", 5): None}


def test_merge_keeps_tombstones_out(spark):
    base = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["x"])], "k long, v string, d array<string>")
    fresh = spark.createDataFrame([(2, "c", ["y"]), (3, "d", ["y"])], "k long, v string, d array<string>")
    out = store.merge(base, fresh, spark.createDataFrame([(3,)], "k long"), key="k", replace=["v"], unite=["d"])
    assert sorted((r.k, r.v, sorted(r.d)) for r in out.collect()) == [(1, "a", ["x"]), (2, "c", ["x", "y"])]


def test_rules_order_bounds_and_default(spark):
    rules = [Rule("a", "x", 70), Rule("b", "y", 60), Rule("c", "z", -500)]
    r = one(spark, f=first_match(F.lit("yx"), rules), s=score(F.lit("xy"), rules), t=score(F.lit("z"), rules), l=labels(F.lit("q"), rules, "none"), n=first_match(F.lit("q"), rules))
    assert (r.f, r.s, r.t, r.l, r.n) == ("a", 100, 0, ["none"], None)


def test_text_scalars(spark):
    r = one(
        spark, key=text.content_key(F.lit("short")), link=text.link_key(F.lit("https://www.A.com/x/?b=2&utm_source=q&a=1#f")), n=text.numbers(F.lit("1,200 dead in 2024, ٣٠ hurt")),
        tidy=text.tidy_headline(F.lit("word " * 40)), newer=text.newer_id(F.lit("100"), F.lit("99")), ent=text.decode_entities(F.lit("<b>a &amp;lt; b</b>")), null=text.norm(F.lit(None).cast("string")),
    )
    assert (r.key, r.link, r.n, r.newer, r.ent, r.null) == ("", "a.com/x?a=1&b=2", [1200, 30], True, "a &lt; b", None)
    assert len(r.tidy) <= 140 and r.tidy.endswith("…")


def test_sets_of_nothing(spark):
    e = F.array().cast("array<string>")
    r = one(spark, j=sets.jaccard(e, e), o=sets.overlap(e, F.array(F.lit("a"))), m=sets.meets(e, F.array(F.lit("a"))), w=sets.rank_weighted(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))))
    assert (r.j, r.o, r.m, r.w) == (0.0, 0.0, True, 0.5)


def test_geometry(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]))
    r = one(
        spark, area=geo.ring_area(ring), inside=geo.within_ring(F.lit(1.0), F.lit(1.0), ring), out=geo.within_ring(F.lit(5.0), F.lit(1.0), ring), km=geo.km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)),
        north=geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), turn=geo.angle_between(F.lit(350.0), F.lit(10.0)), line=geo.to_line_km(F.lit(0.0), F.lit(0.0), ring),
    )
    assert (r.area, r.inside, r.out, r.north, r.turn, r.line) == (16.0, True, False, 0.0, 20.0, 0.0) and abs(r.km - 20015.09) < 0.01


def test_clock_across_daylight_saving(spark):
    # 25 October 2026, 00:30 UTC: clocks in Jerusalem go back that night.
    t = F.lit(1792888200).cast("long")
    r = one(spark, d=clock.local_day(t, "Asia/Jerusalem"), n=clock.night_day(t), w=clock.window_start(t, 3), due=clock.due(t, F.lit(None).cast("long"), F.lit(5)))
    assert str(r.d) == "2026-10-25" and str(r.n) == "2026-10-24" and (r.w + 10800) % 10800 == 0 and r.due


def test_search_respells_by_one_edit(spark):
    words = spark.createDataFrame([("harbor",)], "word string")
    lexicon = spark.createDataFrame([("harbour", 5), ("harbot", 9), ("arbor", 1), ("tree", 50)], "word string, df long")
    assert [r.candidate for r in search.respelled(words, lexicon).orderBy(F.desc("df")).collect()] == ["harbot", "harbour", "arbor"]


def test_jump_waits_for_a_second_fix():
    state, ok = stateful._step(None, (0, 10.0, 10.0))
    state, held = stateful._step(state, (60, 12.0, 12.0))
    state, agreed = stateful._step(state, (120, 12.01, 12.01))
    assert (ok, held, agreed) == (True, False, True)


def test_rest_does_not_import_the_optional_subpackage():
    code = "import sys; import tideline.catalog as c; assert c.QUERIES; assert not [m for m in sys.modules if m.startswith('tideline.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.parametrize("missing", ["tideline.llm", "corpus_pipeline"])
def test_entry_without_the_optional_parts(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; sys.path.insert(0, '.'); import __spark_entry__ as e; assert 'feed_page' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_spacing_is_greedy(spark, sf_dir):
    from tideline.plans.extras import spaced_ports
    from tideline.plans.places import ports

    kept = []
    for p in sorted(ports(spark, sf_dir).collect(), key=lambda p: p.name):
        if all(stateful._km(p.lat, p.lon, q.lat, q.lon) > 600 for q in kept):
            kept.append(p)
    assert sorted(p.name for p in kept) == sorted(r.name for r in spaced_ports(spark, sf_dir).collect())


def test_shapes():
    from tideline.functions.shapes import clip, simplify

    assert simplify([(0, 0), (1, 0.1), (2, 0), (3, 3)], 0.5) == [(0, 0), (2, 0), (3, 3)] and simplify([], 1) == []
    assert sorted(clip([(-1, -1), (3, -1), (3, 3), (-1, 3)], (0, 0, 2, 2))) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert clip([(5, 5), (6, 5), (6, 6)], (0, 0, 2, 2)) == []


def test_persian_new_year(spark):
    r = one(spark, p=clock.persian(F.to_date(F.lit("2024-03-20"))), d=clock.from_persian(F.lit(1403), F.lit(1), F.lit(1)))
    assert tuple(r.p) == (1403, 1, 1) and str(r.d) == "2024-03-20"


def test_latest_of_others_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randrange(300), rng.randrange(3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, t long, o int")
    want = {}
    for i, k, t, o in rows:
        early = [(u, j) for j, q, u, p in rows if q == k and p != o and t - 40 <= u < t]
        if early:
            want[i] = max(early)[1]
    assert {r.id: r.parent for r in joins.latest_of_others(df, ["k"], "t", "id", "o", 40).collect()} == want and len(want) > 100
    assert joins.latest_of_others(df.limit(0), ["k"], "t", "id", "o", 40).count() == 0


def test_numbers_by_stretches(spark):
    from tideline.operators import ordered

    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, rng.randrange(-50, 200)])) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, k string, at long")
    for falling in (False, True):
        order = sorted(rows, key=lambda r: ((r[2] is not None) != falling, (-1 if falling else 1) * (r[2] or 0), r[0]))
        seen, want = {}, {}
        for i, k, _ in order:
            want[i] = seen[k] = seen.get(k, 0) + 1
        assert {r.id: r.n for r in ordered.numbered(df, ["k"], "at", ["id"], "n", width=30, falling=falling).collect()} == want


def test_last_greater(spark):
    from tideline.operators import ordered

    rng = random.Random(3)
    rows = [(k, t, rng.choice([None, rng.randrange(30)])) for k in "ab" for t in rng.sample(range(300), 80)]
    out = ordered.previous_greater(spark.createDataFrame(rows, "k string, t long, v long"), ["k"], "t", "v", width=20)
    want = {(k, t): max((u for q, u, w in rows if q == k and u < t and w is not None and v is not None and w > v), default=None) for k, t, v in rows}
    assert {(r.k, r.t): r.since for r in out.collect()} == want


def test_terms_of_merged_groups_are_not_gathered_to_be_made_distinct(spark):
    """Terms of one group stream out of the join; terms of several groups and of none count once all the same."""
    own = [(1, "a"), (1, "b"), (1, "b"), (2, "c"), (3, "z"), (3, None), (4, "a"), (4, "z")]
    other = [("g", "a"), ("g", "b"), ("g", "d"), ("g", "d"), ("h", "b"), ("h", "c"), ("h", "d"), ("i", None), ("j", "e"), (None, "a"), (None, "f")]
    df = merging.merge_groups(spark.createDataFrame(own, "id int, term string"), spark.createDataFrame(other, "id string, term string"))
    want = {(i, t) for i, t in own if t}
    want |= {(i, t) for i, s in own if s for g, u in other if g and s == u for h, t in other if h == g and t}
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    assert df._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # Aggregate before
