"""Queries that SQL cannot express, against plain versions on the smallest tables, and scalars of wording."""

import os
import random
import re
from math import asin, cos, hypot, radians, sin, sqrt

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_operators import one
from tideline import catalog
from tideline.functions import text
from tideline.operators import fold, joins, ordered_fold
from tideline.plans import marks
from tideline.plans.similar import _HEAD
from tideline.session import POSITIONS, REPORTS


@pytest.fixture(scope="module")
def rows(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return lambda sql: con.execute(sql).fetchall()


def km(a, b, c, d):
    x, y = sin(radians(c - a) / 2), sin(radians(d - b) / 2)
    return 2 * 6371 * asin(min(1.0, sqrt(x * x + cos(radians(a)) * cos(radians(c)) * y * y)))


def greedy(items, alike):
    """copy -> home; items in order of time."""
    homes, taken = [], {}
    for x in items:
        home = next((h for h in homes if alike(h, x)), None)
        if home is None:
            homes.append(x)
        else:
            taken[x[0]] = home[0]
    return taken


def test_folded(spark, sf_dir, rows):
    items = rows(f"WITH {REPORTS} SELECT fp, at_, desk, source, {_HEAD} AS w FROM reports ORDER BY at_, fp")

    def alike(a, b):
        v, w = set(a[4] or []), set(b[4] or [])
        return a[2] is not None and a[2] == b[2] and b[1] - a[1] <= 43200 and bool(v and w) and len(v & w) / len(v | w) >= 0.4

    taken = greedy(items, alike)
    source = {x[0]: x[3] for x in items}
    want = []
    for x in items:
        if x[0] not in taken:
            copies = [c for c, h in taken.items() if h == x[0]]
            want.append((x[0], x[3], len(copies), ",".join(sorted({source[c] for c in copies})) if copies else None))
    assert taken and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in catalog.QUERIES["folded"](spark, sf_dir).select("fp", "source", "copies", "also").collect())


def test_one_pin(spark, sf_dir, rows):
    items = rows(f"WITH {POSITIONS} SELECT event_id, event_type, t, lat, lon FROM positions ORDER BY t, event_id")
    taken = greedy(items, lambda a, b: a[1] == b[1] and b[2] - a[2] <= 3600 and km(*a[3:], *b[3:]) <= 500)
    want = {(x[0], sum(h == x[0] for h in taken.values())) for x in items if x[0] not in taken}
    assert taken and {tuple(r) for r in catalog.QUERIES["one_pin"](spark, sf_dir).collect()} == want


def test_stream_positions(spark, sf_dir, rows):
    last, held, want = {}, {}, []
    for key, t, lat, lon in rows(f"WITH {POSITIONS} SELECT key, t, lat, lon FROM positions ORDER BY key, t, lat, lon"):
        ok = True
        if key in last:
            away = km(*last[key][1:], lat, lon)
            if away > 20 and away / 1.852 / (max(t - last[key][0], 1) / 3600) > 60:
                ok = key in held and t - held[key][0] <= 3600 and km(*held[key][1:], lat, lon) <= 10
        if ok:
            last[key] = (t, lat, lon)
            held.pop(key, None)
        else:
            held[key] = (t, lat, lon)
        want.append((key, t, round(lat, 6), round(lon, 6), ok))
    got = [(r.key, r.t, round(r.lat, 6), round(r.lon, 6), r.accepted) for r in catalog.QUERIES["stream_positions"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and {w[-1] for w in want} == {True, False}


def simple(points, tolerance):
    """Number of points kept between the ends of a line, ends not counted."""
    (ax, ay), (bx, by) = points[0], points[-1]
    size, worst, at = hypot(bx - ax, by - ay), 0.0, None
    for i, (x, y) in enumerate(points[1:-1], 1):
        off = abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / size if size else hypot(x - ax, y - ay)
        if at is None or off > worst:
            worst, at = off, i
    return 0 if at is None or worst <= tolerance else 1 + simple(points[: at + 1], tolerance) + simple(points[at:], tolerance)


def cut(ring, inside, cross):
    out = []
    for i in range(len(ring)):
        p, q = ring[i - 1], ring[i]
        if inside(p) != inside(q):
            out.append(cross(p, q))
        if inside(q):
            out.append(q)
    return out


def test_shaped_tracks(spark, sf_dir, rows):
    tracks = {}
    for key, t, lat, lon in rows(f"WITH {POSITIONS} SELECT key, t, lat, lon FROM positions ORDER BY key, t, lon, lat"):
        tracks.setdefault((key, t // 86400), []).append((lon, lat))

    def across(axis, bound):
        def cross(p, q):
            part = (bound - p[axis]) / (q[axis] - p[axis])
            return p[0] + part * (q[0] - p[0]), p[1] + part * (q[1] - p[1])

        return cross

    want = set()
    for (key, day), points in tracks.items():
        ring = cut(points, lambda p: p[0] >= -100, across(0, -100))
        ring = cut(ring, lambda p: p[1] >= -40, across(1, -40))
        ring = cut(ring, lambda p: p[0] <= 100, across(0, 100))
        ring = cut(ring, lambda p: p[1] <= 40, across(1, 40))
        want.add((key, day, len(points), min(len(points), 2) + simple(points, 0.5), len(ring)))
    assert {tuple(r) for r in catalog.QUERIES["shaped_tracks"](spark, sf_dir).select("key", "day", "n", "n_simple", "n_inside").collect()} == want


def test_dictionary_matches_odd_input(spark):
    texts = spark.createDataFrame([(1, ["a", "b", "c", "a", "b"]), (2, None), (3, []), (4, ["b"]), (5, ["b", "c", "d"])], "id long, w array<string>")
    names = spark.createDataFrame([("a b", 1), ("b", 2), ("b c d", 3), (None, 4), ("c a b", 6), ("a b c a b x", 5), ("a b c a b", 7)], "alias string, place long")
    got = {tuple(r) for r in joins.dictionary_matches(texts, "id", F.col("w"), names, "alias").select("id", "at", "n", "alias", "place").collect()}
    assert got == {(1, 0, 5, "a b c a b", 7), (4, 0, 1, "b", 2), (5, 0, 3, "b c d", 3)}
    assert joins.dictionary_matches(texts.limit(0), "id", F.col("w"), names, "alias").count() == 0


def test_numbers_by_value(spark):
    cases = [("1,200,000 barrels", 1.2e6, True, None), ("31 hit.", 31, True, None), ("in 31, of", 31, True, None), ("1,282 hit", 128, False, None), ("12.5 hit", 12, False, None), ("1.2.3.31", 31, False, None), (None, 3, False, None), ("", 0, False, None),
             ("At least 12 hurt", 12, True, "at least"), ("more than 1.2 million", 1.2e6, True, "more than"), ("nearly 7 km", 7, True, "about"), ("at least 120", 12, False, None), ("12 at least", 12, True, None), ("3 thousand, about 12345678901", 12345678901, True, "about"),
             ("roughly 5 thousand", 5000, True, "about"), ("12,34", 1234, False, None), ("x" * 60_000 + " above 9", 9, True, "more than")]
    df = spark.createDataFrame([(t, float(n)) for t, n, *_ in cases], "t string, n double").withColumn("x", text.told_numbers(F.col("t")))
    got = [tuple(r) for r in df.select(text.states(F.col("x"), F.col("n")), text.qualifier_of(F.col("x"), F.col("n"))).collect()]
    assert got == [(a, b) for *_, a, b in cases]


def test_spellings_meet(spark):
    row = one(spark, a=text.consonants(F.lit("al-Madaribah")), b=text.consonants(F.lit("Mudaribah")), c=text.consonants(F.lit("Shadaa")), d=text.consonants(F.lit("Shada")), e=text.consonants(F.lit("")))
    assert row.a == row.b and row.c == row.d and row.e == ""
    assert one(spark, x=text.latin_digits(F.lit("۱۲٣ Kیک"))).x == "123 kيك"


def broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Broadcast" in plan


@pytest.mark.parametrize("name", ["same_footage", "spatial_twins"])
def test_map_joins_send_no_table_through_the_driver(spark, sf_dir, name):
    assert not broadcasts(catalog.QUERIES[name](spark, sf_dir))


def crowd(spark, folder):
    """Events with many copies, repeated rows, nulls, values a whole 1 apart, and ids against the order of time; the events and SQL over them."""
    rng = random.Random(5)
    rows = [(1000 + i, f"2024-01-01 00:{rng.randrange(60):02d}:00", rng.choice([3, 4, 1503, 90]), rng.choice("ab"), rng.choice([7.99, 8.0, 8.29, 9.29, 10.01, 9.01])) for i in range(150)]
    rows += [(240 * i, "2024-01-01 03:00:00", 7, "a", 20.5) for i in range(300)] + [(1000 + i, None, 3, "a", None) for i in range(3)]
    rows += [rows[0], rows[0], (5, "2024-01-01 00:00:00", None, "a", 9.0), (6, "2024-01-01 00:00:00", 3, None, 9.0), (7, "2024-01-01 00:00:00", 3, None, 9.0)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["same_footage", "spatial_twins"])
def test_twins_are_listed_in_pairs(spark, tmp_path, name):
    """Every pair is a row, whichever of the two has the lower id."""
    con = crowd(spark, tmp_path)
    p = con.execute(f"WITH {POSITIONS} SELECT event_id, event_type, t, value, lat, lon FROM positions").fetchall()
    p = [a for a in p if None not in (a if name == "same_footage" else (*a[:3], *a[4:]))]

    def link(a, b):
        if name == "same_footage":
            return a[0] < b[0] and a[1] == b[1] and min(a[3], b[3]) >= 8 and abs(a[3] - b[3]) <= 1 and km(*a[4:], *b[4:]) <= 200
        return a[0] != b[0] and (a[2], a[0]) < (b[2], b[0]) and a[1] == b[1] and b[2] - a[2] <= 3600 and km(*a[4:], *b[4:]) <= 500

    want = sorted((a[0], b[0]) for a in p for b in p if link(a, b))
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert df.columns == ["early", "late"] and sorted(tuple(r) for r in df.collect()) == want and len(want) > 300 * 299 // 2
    assert name == "same_footage" or any(a > b for a, b in want)
    assert sorted(con.execute(catalog.ORACLES[name]).fetchall()) == want


def test_one_pin_makes_no_pairs(spark, tmp_path, monkeypatch):
    """Fixes are folded in order: copies, repeated rows, nulls, ids against the order of time."""
    con = crowd(spark, tmp_path)
    monkeypatch.setattr(joins, "near", None)
    p = con.execute(f"WITH {POSITIONS} SELECT event_id, event_type, t, lat, lon FROM positions").fetchall()
    order = sorted((x for x in p if None not in x), key=lambda x: (x[2], x[0]))
    taken = greedy([(i, *x) for i, x in enumerate(order)], lambda a, b: a[2] == b[2] and b[3] - a[3] <= 3600 and km(*a[4:], *b[4:]) <= 500)
    want = sorted([(x[0], list(taken.values()).count(i)) for i, x in enumerate(order) if i not in taken] + [(x[0], 0) for x in p if None in x])
    assert sorted(tuple(r) for r in catalog.QUERIES["one_pin"](spark, str(tmp_path)).collect()) == want and len(want) > 12


def test_first_near_others(spark):
    day = 86_400
    rows = [(1, "a", 1, 0, 10.0, 179.9), (2, "a", 1, 5, 10.0, -179.9), (3, "a", 2, 6 * day, 10.0, -179.9), (4, "a", 2, 9 * day, 10.0, 179.9), (5, "b", 3, 5, 10.0, 179.9),
            (6, "a", 3, 6 * day, 10.0, -179.9), (7, None, 3, 0, 10.0, 179.9), (8, "a", None, 0, 10.0, 179.9), (9, "a", 4, 0, None, 179.9), (10, "a", 1, 0, 10.0, 179.9), (11, "a", 5, 12 * day, -60.0, 0.0)]
    p = spark.createDataFrame(rows, "id int, kind string, key int, t long, lat double, lon double")
    got = {tuple(r) for r in joins.first_near(p, "id", ["kind"], "t", "key", 60, back=day, ahead=7 * day).collect()}
    want = {}
    for i, kind, key, t, lat, lon in rows:
        found = [(t_, i_) for i_, kind_, key_, t_, lat_, lon_ in rows if None not in (kind, kind_, key, key_, lat, lat_) and kind == kind_ and key != key_ and -day <= t_ - t <= 7 * day and km(lat, lon, lat_, lon_) <= 60]
        if found:
            want[i] = min(found)[1]
    assert want and got == set(want.items())


def test_copies_of_a_place_are_asked_for_once(spark):
    p = spark.createDataFrame([(3, 1.0, 2.0), (1, 1.0, 2.0), (2, 1.0, None), (4, 1.0, None)], "id int, lat double, lon double")
    assert {tuple(r) for r in joins.at_once(p, ["lat", "lon"], "id").select("id", "n").collect()} == {(1, 2), (2, 1), (4, 1)}
    ports = spark.createDataFrame([("b", 1.0, 2.0), ("a", 1.0, 2.0), ("c", 1.0, 3.0)], "name string, lat double, lon double")
    assert {(r.id, r.name, r.km) for r in joins.nearest(p, ports, "id", 50, "name").collect()} == {(1, "a", 0.0), (3, "a", 0.0), (2, None, None), (4, None, None)}


def test_spaced_ports(spark, tmp_path):
    """Against a plain fold over names; ports of one place, names that stand at two places, repeated rows."""
    keys = [*range(1, 40), *range(1000, 1040), 1, 2, 2000, 3000, 6000]
    rows = [(k, f"n{k % 1000 if k < 1010 else k:04d}") for k in keys]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    places = [(name, k % 100 - 50 + 0.5, k * 7 % 300 - 150 + 0.5) for k, name in rows]
    stay = []
    for name in sorted({p[0] for p in places}):
        if all(km(*p[1:], *q[1:]) > 600 for p in places if p[0] == name for q in places if q[0] in stay):
            stay.append(name)
    assert sorted(tuple(r) for r in catalog.QUERIES["spaced_ports"](spark, str(tmp_path)).collect()) == sorted(p for p in places if p[0] in stay)


def test_first_letters_that_become_several(spark, tmp_path):
    letters = [chr(n) for n in range(0x10000) if len(chr(n).upper()) > 1]
    spark.createDataFrame([(i, f"{c}tadt", "de", "s", 5) for i, c in enumerate([*letters, "é", "1", "ж", ""])], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(f"SELECT fp, sentence FROM ({catalog.ORACLES['text_keys']})").fetchall())
    got = {r.fp: r.sentence for r in catalog.QUERIES["text_keys"](spark, str(tmp_path)).collect()}
    assert got == want and "SStadt" in got.values()


def test_points_of_voices_are_folded_by_voice(spark, sf_dir, monkeypatch):
    keys = []
    monkeypatch.setattr(marks, "fold_in_order", lambda rows, by, *a: keys.append(by) or ordered_fold.fold_in_order(rows, by, *a))
    assert catalog.QUERIES["points_of_voices"](spark, sf_dir).count() and keys == [["desk", "voice"]]
    step, ends = marks._one_point(55), set()
    for begin in (None, 20, 40, 55):
        for n in (20, 30, 5, 3, *[1] * 40):
            begin, _ = step(begin, {"n": n})
        ends.add(begin)
    assert ends == {55} and step(None, {"n": 900}) == (56, {"fate": "stays"}) and step(56, {"n": 0})[1] == {"fate": "dropped"} and step(55, {"n": 0})[1] == {"fate": "joins"}


def test_similar_sets_are_not_repeated_for_their_words(spark):
    items = spark.createDataFrame([("a", "d", 0, ["x", "y", "z"]), ("b", "d", 9, ["x", "y", "y", None]), ("c", "d", 9, []), ("e", "d", 9, None), ("f", None, 9, ["x", "y", "z"])], "k string, desk string, t long, w array<string>")
    both = fold.jaccard_pairs(items, key="k", block=["desk"], at="t", words=F.col("w"), least=0.6, within=10)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # the time's buckets
    assert [(r.early, r.late, round(r.similarity, 6)) for r in both.collect()] == [("a", "b", 0.666667)]


def test_a_text_is_gone_through_once_for_its_numbers(spark):
    rng, pieces = random.Random(3), ["ab", "c", " ", " ", "5", "1,234", ".", "7", " thousand", " million", "s", "\n", "é"]
    texts = ["5 thousands 7", "ab cd ef gh 5", "abc5 6", None] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(300)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.told_numbers(F.col("t")).alias("x"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1  # three times before
    for r in found.collect():
        hits = re.findall(text.TOLD, re.sub("[ \t\n]+", " ", (r.t or "").lower()))
        fits = [w.strip(" ") for w, n, _ in hits if re.fullmatch(r"([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]+)?", re.sub("[.,]+$", "", n))]
        assert [x["before"] for x in r.x] == fits


def shuffled_rows(spark, group: str) -> int:
    """Rows that the stages of a job group wrote for others."""
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(s)}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_citations_leave_frequent_words_where_they_are_read(spark, tmp_path):
    texts = [(i, " ".join([*(f"frequent{k % 50}" for k in range(200)), f"rarity{i // 3}"]), f"s{i % 4}") for i in range(300)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sparkContext.setJobGroup("citations", "")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so small a table stands for a large one
    try:
        got = {tuple(r) for r in catalog.QUERIES["citations"](spark, str(tmp_path)).select("doc_id", "cited", "at_", "home").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setJobGroup("", "")
    assert got == {(i, f"rarity{i // 3}", 200, max(f"s{k % 4}" for k in range(i // 3 * 3, i // 3 * 3 + 3))) for i in range(300)}
    assert 0 < shuffled_rows(spark, "citations") < 10_000  # of 60,300 words


@pytest.mark.parametrize("common", [0, 1, 5, 1000])
def test_first_cited_odd_input(spark, tmp_path, common):
    rows = [(i, f"-- Often{i % 7} a bc, often{i % 3} rare{i // 4:03d}! Single{i}x rare{i // 4:03d} thrice{i % 20:02d}", f"s{i % 3}") for i in range(60)]
    rows += [(60, None, "s1"), (61, "", "s1"), (62, "... rare001", "s2"), (63, "SINGLE3X", "s0"), (64, "rare02", None), (65, "rare02", None), (66, "rare02", "s1")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = set(con.execute(f"SELECT doc_id, cited, at_, home FROM ({catalog.ORACLES['citations'].replace('BETWEEN 2 AND 40', 'BETWEEN 2 AND 5')})").fetchall())
    got = marks.first_cited(documents, text.words(F.col("text")), most=5, common=common).select("doc_id", "cited", "at_", "home").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 40
