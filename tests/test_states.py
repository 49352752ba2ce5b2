"""States by batch, clusters, absorption and cascades against plain versions."""

import math
import random

from pyspark.sql import functions as F

from tideline.operators import cascade, clusters, control, joins, ordered_fold


def plain_control(state, claims, batch, now, lapse):
    out = {}
    for place in {c[0] for c in claims if c[0] and c[1]} | set(state):
        side, was, since, done = state.get(place, ("", None, None, None))
        mine = [c for c in claims if c[0] == place and c[1]]
        if done is not None and done >= batch:
            out[place] = (side, was, since, done)
            continue
        rivals = {c[1] for c in mine} - {side}
        won = []
        for s in sorted(rivals):
            whole = [c for c in mine if c[1] == s and c[2]]
            if whole and (any(c[5] for c in whole) or len({c[4] or "own " + c[3] for c in whole}) >= 2):
                won.append(s)
        to = side
        if side == "contested" and not mine:
            to = (was or "") if now - since >= lapse else side
        elif rivals:
            to = won[0] if len(won) == 1 else "contested"
        latest = max((c[6] for c in mine), default=None)
        if to != side:
            was, since = (side if to == "contested" else was), latest if latest is not None else now
        elif side == "contested" and latest is not None:
            since = max(since, latest)
        out[place] = (to, was, since, batch)
    return out


def test_control_over_three_batches_and_again(spark):
    rng = random.Random(7)
    state = {f"p{i}": (rng.choice(["a", "b", "contested", ""]), "a", 0, 0) for i in range(12)}
    kind = "place string, side string, whole boolean, outlet string, camp string, wire boolean, at long"
    frame = lambda s: spark.createDataFrame([(k, *v) for k, v in s.items()], control.STATE)
    read = lambda df: {r.place: (r.side, r.was, r.since, r.batch) for r in df.collect()}
    df, want, batches = frame(state), state, []
    for n in (1, 2, 3):
        claims = [(f"p{rng.randrange(16)}", rng.choice(["a", "b", None]), rng.random() < 0.5, f"o{rng.randrange(5)}", rng.choice([None, "x", "y"]), rng.random() < 0.1, n * 1000 + rng.randrange(900)) for _ in range(14)] + [(None, "a", True, "o", None, True, 5)]
        batches.append(claims + claims[:3])
        df = frame(read(control.apply_batch(df, spark.createDataFrame(batches[-1], kind), n, n * 1000 + 999, lapse=900)))
        want = plain_control(want, claims, n, n * 1000 + 999, 900)
        assert read(df) == want
        # The same batch again, and an older one, change nothing.
        for m in (n, 1):
            again = control.apply_batch(df, spark.createDataFrame(batches[m - 1], kind), m, 10**6, lapse=1)
            assert read(again) == want and again.filter("changed").count() == 0
    assert {v[0] for v in want.values()} >= {"a", "b", "contested"}
    assert read(control.apply_batch(df, spark.createDataFrame([], kind), 9, 10**6, lapse=10**7)) == {k: (*v[:3], 9) for k, v in want.items()}


def km(a, b):
    s = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(s)))


def test_pairs_near_the_poles_and_the_date_line(spark):
    rng = random.Random(1)
    pts = [(i, rng.choice([rng.uniform(88, 90), -90.0, 90.0, rng.uniform(-90, -88.5), rng.uniform(-2, 2), rng.uniform(59, 61)]), rng.choice([rng.uniform(-180, 180), 179.9, -179.95, 180.0])) for i in range(220)] + [(900, None, 1.0)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    for d in (40.0, 150.0):
        got = sorted((r.id, r.id_r) for r in joins.near(df, df, d).collect())
        assert got == sorted((a[0], b[0]) for a in pts for b in pts if None not in (a[1], b[1]) and km(a[1:], b[1:]) <= d)


def test_clusters_across_cells_keep_their_identity(spark):
    """Reports a few kilometres apart in a row over many cells, two outlets; a far pair; one busy place of one outlet."""
    line = [(10 + 0.1 * k, 20 + 0.1 * k, 100 + k, f"s{k % 2}", "Line") for k in range(30)]
    more = [(50.0, 5.0, 100, "s1", "Far"), (50.1, 5.1, 100, "s2", "Far")] + [(-5.0, 5.0, 100, "one", "Busy")] * 50
    late = [(lat + 0.2, lon, t + 1000, s, n) for lat, lon, t, s, n in line[:20]]
    df = spark.createDataFrame([*line, *more, *late, (None, 1.0, 100, "x", None)], "lat double, lon double, t long, source string, name string")
    run = lambda o, now: clusters.move_clusters(o, df, now, radius=35.0, window=500, retire=800)
    first = run(spark.createDataFrame([], clusters.OPEN), 200)
    rows = first.collect()
    assert len(rows) == 1 and rows[0].name == "Line" and abs(rows[0].lat - sum(r[0] for r in line) / 30) < 0.001 and rows[0].opened == 200 and rows[0].active == 129
    open_ = spark.createDataFrame(rows, clusters.OPEN)
    second = run(open_, 1200).collect()
    assert [r.id for r in second] == [rows[0].id] and second[0].opened == 200 and second[0].active == 1119 and second[0].lat != rows[0].lat
    assert run(spark.createDataFrame(second, clusters.OPEN), 1900).count() == 1 and run(spark.createDataFrame(second, clusters.OPEN), 2000).count() == 0


def test_components_against_a_plain_search(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"z{k:02d}", f"z{k + 1:02d}") for k in range(40)]
    nodes = sorted({f"n{k:02d}" for k in range(60)} | {x for pair in links for x in pair})
    both = links + [(b, a) for a, b in links]
    out = clusters.components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(both, "a string, b string"))
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in both:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in out.collect()} == root


def test_absorption_is_one_to_one(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["red", "red", "bab", None]), rng.choice([None, *range(12)]), rng.random() < 0.4) for i in range(150)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, sea string, day int, is_named boolean").filter("sea is not null")
    got = {r.id: r.partner for r in ordered_fold.absorb(df, "sea", block_rows=20).collect()}
    want, waiting = {}, []
    for i, sea, day, named in sorted((r for r in rows if r[1]), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        fits = [w for w in waiting if day is not None and w[1] == sea and w[3] != named and day - w[2] <= 1]
        want[i] = fits[0][0] if fits else None
        if fits:
            waiting.remove(fits[0])
        elif day is not None:
            waiting.append((i, sea, day, named))
    taken = [p for p in got.values() if p is not None]
    assert got == want and len(taken) == len(set(taken)) > 20


def test_absorption_folds_only_what_can_meet(spark, monkeypatch):
    rows, fold, seen = [(i, "red", i // 300, i in (5, 640)) for i in range(900)], ordered_fold.fold_in_order, []

    def counted(some, *args, **more):
        seen.append(some.count())
        return fold(some, *args, **more)

    monkeypatch.setattr(ordered_fold, "fold_in_order", counted)
    got = {r.id: r.partner for r in ordered_fold.absorb(spark.createDataFrame(rows, "id long, sea string, day int, is_named boolean"), "sea").collect()}
    assert len(got) == 900 and {k: p for k, p in got.items() if p is not None} == {5: 0, 640: 300} and seen == [6]  # all 900 before, each with hundreds as its state


def test_no_row_is_tried_twice(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, None, "x"), (4, "b", None), (5, None, None), (6, "c", "y")]
    df = spark.createDataFrame(rows, "id int, k string, l string")
    first = spark.createDataFrame([("a", 10), ("c", 60)], "key string, answer int")
    second = spark.createDataFrame([("x", 20), ("y", 70)], "key string, answer int")
    out = cascade.answer(df, "id", [cascade.Attempt("first", F.col("k"), first, F.col("candidate") < F.col("id") * 10 + 1), cascade.Attempt("second", F.col("l"), second, F.col("id") != 2)])
    assert sorted(map(repr, (tuple(r)[0:1] + tuple(r)[3:] for r in out.collect()))) == sorted(map(repr, [(1, 10, "first", 1), (2, None, None, 2), (3, 20, "second", 1), (4, None, None, 1), (5, None, None, 0), (6, 60, "first", 1)]))
    assert cascade.best_of(spark.createDataFrame([("a", 3), ("a", 2), (None, 1)], "k string, v int"), F.col("k"), "v").collect() == [("a", 2)]
