"""Rewriting against a plain scan from the left, and names against every name of the table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.operators import matching, rewriting
from tideline.plans.rewriting import _RUN, _STRAIGHT, KINDS, LETTERS, preferred_spellings


def plain(text, entries):
    """From the left, the longest entry that stands at a place as whole words."""
    if text is None:
        return None, 0
    part, out, i, many = lambda c: c.isalnum() or c == "_", "", 0, 0
    while i < len(text):
        fits = [p for p in entries if text.startswith(p, i) and not (i and part(text[i - 1])) and not (i + len(p) < len(text) and part(text[i + len(p)]))]
        if fits:
            best = max(fits, key=len)
            out, i, many = out + entries[best], i + len(best), many + 1
        else:
            out, i = out + text[i], i + 1
    return out, many


@pytest.mark.parametrize("block", [7, 1000])
def test_rewrite(spark, block):
    rng = random.Random(12)
    words = ["a", "ab", "New", "York", "é", "x_y", "-", "City", "123", "العربية"]
    entries = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))): rng.choice(["", "X", "New York", "a b"]) for _ in range(40)}
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "", ".", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(200)] + [None, "", "a " * 50_000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "id int, text string, n_rewritten int")
    known = spark.createDataFrame([*entries.items(), (None, "z"), ("", "z"), ("New", None), ("New", "zz")], "pattern string, replacement string")
    entries["New"] = min("", entries.get("New", ""))
    got = {r.id: (r.text, r.n_rewritten) for r in rewriting.rewrite(df, "text", known, block=block).collect()}
    assert got == {i: plain(t, entries) for i, t in enumerate(texts)}
    assert [tuple(r) for r in rewriting.rewrite(df.filter("id < 3"), "text", known.limit(0)).collect()] == [(i, texts[i], 0) for i in range(3)]


def test_one_block_hands_no_hits_on_and_reads_texts_once(spark, tmp_path):
    texts = spark.createDataFrame([(1, "New York is big"), (2, None)], "id int, text string")
    known = spark.createDataFrame([("New York", "NY"), ("is", "was")], "pattern string, replacement string")
    out = rewriting.rewrite(texts, "text", known)
    assert sorted(map(tuple, out.collect())) == [(1, "NY was big", 2), (2, None, 0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # two before
    spark.createDataFrame([("alle alle wort wort werd",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    words = preferred_spellings(spark.read.parquet(f"{tmp_path}/d"), least=2)
    assert "d/part" not in "".join(words.inputFiles()) and "regexp_extract_all" not in words._jdf.queryExecution().optimizedPlan().toString()  # three times before
    assert [tuple(r) for r in words.collect()] == [("werd", "wort")]


def test_a_large_dictionary_is_held_by_no_task(spark, monkeypatch):
    """Each text is brought the patterns that its own words ask for, whatever the dictionary holds."""
    rng, parts = random.Random(4), ["a", "b_", "é9", "New", "York", " ", "  ", "-", ", ", "...", "!", "\n", "٣", "𝒳"]
    entries = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 6))): rng.choice(["", "X", "a b", "-"]) for _ in range(300)} | {f"unseen{n}": "" for n in range(300)}
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] * 2 + [None, "", "...", "-", " "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    shared, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: shared.append(x) or broadcast(x))
    out = rewriting.rewrite(df, "t", spark.createDataFrame([*entries.items()], "pattern string, replacement string"), block=100)
    assert {r.i: (r.t, r.n_rewritten) for r in out.collect()} == {i: plain(t, entries) for i, t in enumerate(texts)}
    assert shared and not any(isinstance(x, list) for x in shared)  # a list of the patterns of each block before
    for text in texts[:60]:
        found = {p for p in entries if rewriting.key_of(p)[0] in rewriting.keys_in(text, {0, 1, 2})}
        assert plain(text, {p: entries[p] for p in found}) == plain(text, entries) and not any("unseen" in p for p in found)


def test_runs_of_other_letters(spark):
    texts = ["to qalat äbc.", "äb cé and é", "éla äbc now", None, "", "plain", "xéla"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    run = r"[A-Za-z]*[À-ÿ][A-Za-zÀ-ÿ]*(?: [A-Za-z]*[À-ÿ][A-Za-zÀ-ÿ]*)*"
    new = rewriting.respell_runs(F.col("t"), run, {"éla": "city"}, [("ä", "ae"), ("é", "e")])
    assert [r.n for r in df.select(new.alias("n")).collect()] == ["to qalat Aebc.", "Aeb Ce and E", "Aebc city now", None, "", "plain", "Xela"]
    assert [r.s for r in spark.createDataFrame([("Kfar",), ("Qaffar",), ("",), (None,), ("aeiou",)], "t string").select(rewriting.sound_key(F.col("t")).alias("s")).collect()] == ["KFR", "KFR", "", None, ""]


def test_prefixes(spark):
    rows = spark.createDataFrame([("2345",), ("23",), ("9",), (None,), ("",), ("2345",)], "n string")
    table = spark.createDataFrame([("2", "two"), ("234", "b"), ("234", "a"), ("", "none"), (None, "none"), ("99", "x")], "p string, v string")
    assert sorted(map(repr, map(tuple, matching.longest_prefix(rows, "n", table, "p").collect()))) == sorted(map(repr, [("2345", "234", "a")] * 2 + [("23", "2", "two"), ("9", None, None), (None, None, None), ("", None, None)]))
    assert matching.longest_prefix(rows, "n", table.limit(0), "p").filter("v is not null").count() == 0
    named = spark.createDataFrame([("uk", "BBC", 3), ("uk", "BBC News", 1), ("uk", "The T", 2), ("fr", "BBC", 0), ("uk", "", 9)], "c string, name string, rank int")
    asked = spark.createDataFrame([("uk", "bbc-news online"), ("uk", "BBCX"), ("uk", "the times"), ("fr", "BBC World"), ("fr", "b b c"), ("uk", None)], "c string, s string")
    assert {(r.c, r.s): r["rank"] for r in matching.ranked_prefix(asked, "s", ["c"], named, "name", "rank").collect()} == {
        ("uk", "bbc-news online"): 1, ("uk", "BBCX"): None, ("uk", "the times"): 2, ("fr", "BBC World"): 0, ("fr", "b b c"): None, ("uk", None): None}


def test_tiers(spark):
    rng = random.Random(6)
    names = [(1, "AL HUDAYDAH", "YEHOD"), (2, "ADEN", "YEADE"), (3, "ADEN OIL PORT", None), (4, "JEBEL ALI", "AEJEA"), (5, "ADEN", None), (6, "ALI", None), (7, None, "XXXXX"), (8, "RAS", None)]
    parts = ["aden", "Jebel", "ALI", "oil port", ">", " TO ", "AE", "JEA", "yeade", "x", "/", "ras", "alhudaydah", "="]
    texts = [None, "", " ", ">", "OMSOH>AEJEA", "ae jea", "JEBELALI ANCH"] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    bare = lambda s: re.sub(r"[^A-Z0-9]+", " ", s.upper()).strip()

    def want(t):
        if t is None:
            return None, None
        d, tail = bare(t), bare(re.sub(r"^.*(?:>|=|\bTO\b)", "", t.upper()))
        found = []
        codes = [m.replace(" ", "") for m in re.findall(r"\b([A-Z]{2} ?[A-Z0-9]{3})\b", d)]
        for place, alias, code in names:
            found += [(0, -i, place) for i, c in enumerate(codes) if c == code]
            if alias:
                for late, s in ((0, tail), (4, d)):
                    k = 1 if s == alias else 2 if s.startswith(alias + " ") else 3 if s.endswith(" " + alias) else 4 if f" {alias} " in s else None
                    found += [(k + late, -len(alias), place)] if k else []
                if len(alias) >= 5 and alias.replace(" ", "") in d.replace(" ", ""):
                    found.append((9, -len(alias), place))
        best = min(found, default=(None, 0, None))
        return best[2], best[0]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.place, r.tier) for r in matching.tiered_match(df, "t", spark.createDataFrame(names, "place int, alias string, code string")).collect()}
    assert {i: (texts[i], g, want(texts[i])) for i, g in got.items() if g != want(texts[i])} == {} and len({g[1] for g in got.values()}) > 6


def test_very_long_runs_and_words(spark):
    """Java reads a run by recursion unless it is told never to step back."""
    texts = ["für " * 50_000 + "x", "a" * 50_000, "größe über äöü 1äb, Äb äb", "", None, "éla für"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    new = {r.i: r.n for r in d.select("i", rewriting.respell_runs(F.col("t"), _STRAIGHT, KINDS, LETTERS).alias("n")).collect()}
    short = d.filter("i > 1").select("i", rewriting.respell_runs(F.col("t"), _RUN, KINDS, LETTERS).alias("n"))
    assert {r.i: r.n for r in short.collect()} == {i: n for i, n in new.items() if i > 1} and new[5] == "Fuer city"
    assert new[0] == "Fuer " * 50_000 + "x" and new[1] == texts[1]
