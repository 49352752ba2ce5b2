"""Ordered pair rules, map joins with keys and times, and parsers on odd input."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import joins
from tideline.operators.pairrules import Rule, homes, matches
from tideline.plans import wording
from tideline.plans.pairs import event, talk
from tideline.sources import tabular


def test_the_first_rule_names_a_pair_and_the_earliest_report_is_home(spark):
    rows = [("a", 0, "x", 1), ("b", 10, "x", 1), ("c", 10, "x", 2), ("d", 200, "x", 2), ("e", 5, None, None), ("f", 5, None, None)]
    cards = spark.createDataFrame(rows, "fp string, at long, k string, v int")
    rules = [Rule("same", 50, F.array("k"), F.col("v") == F.col("v_e")), Rule("near", 20, F.array("k"), F.lit(True)), Rule("any", 500, F.array("k"), F.col("v_e") > 1)]
    found = matches(cards, rules)
    assert {(r.early, r.late): r.rule for r in found.collect()} == {("a", "b"): "same", ("a", "c"): "near", ("b", "c"): "near", ("c", "d"): "any"}
    assert {r.late: (r.home, r.rule) for r in homes(found, cards).collect()} == {"b": ("a", "same"), "c": ("a", "near"), "d": ("c", "any")}
    assert matches(cards.filter("false"), rules).collect() == []


def test_near_with_keys_and_times(spark):
    rows = [(1, "a", 0, 10.0, 179.9), (2, "a", 50, 10.0, -179.9), (3, "b", 50, 10.0, 179.9), (4, "a", 500, 10.0, 179.9), (5, None, 0, 10.0, 179.9)]
    p = spark.createDataFrame(rows, "id int, kind string, t long, lat double, lon double")
    got = {(r.id, r.id_r) for r in joins.near(p, p, 60, keys=["kind"], at="t", back=100).filter("id <> id_r").collect()}
    assert got == {(2, 1)}


def test_parsers_on_odd_documents(spark):
    rows = [("B,A\r\n1,x\n\n 2 , y", "<tr><td>2024-01-02</td><td>1,5</td></tr><tr><td>?</td><td>3</td></tr><tr></tr>", '{"posts":[{"text":"no id"},{"id":"1"}]}'), ("", "", "not json"), (None, None, None)]
    d = spark.createDataFrame(rows, "csv string, page string, json string")
    out = d.select(tabular.csv_cells(F.col("csv"), ["a", "b", "c"]).alias("c"), tabular.table_points(F.col("page")).alias("t"), tabular.posts(F.col("json")).alias("p"), tabular.grid_points(F.col("page")).alias("g")).collect()
    assert [tuple(x) for x in out[0].c] == [("x", "1", None), ("y", "2", None)] and [x.v for x in out[0].t] == [15.0] and [(x.id, x.photos) for x in out[0].p] == [("1", 0)]
    assert not out[1].c and not out[1].t and not out[1].p and out[2].c is None and out[2].t is None and not out[1].g


def test_names_that_sound_alike(spark):
    d = spark.createDataFrame([("arakchi", "araghchi"), ("Mahmoud", "Mahmud"), ("hussein", "husein")], "a string, b string")
    assert all(r.same for r in d.select((text.sound(F.col("a")) == text.sound(F.col("b"))).alias("same")).collect())


LONG = "transform(sequence(1, 300), x -> concat('word', x)) as w, array('7') as figures, 'd' as desk, 's' as source, 'same news' as norm, 'word' as speaker"


def test_long_headlines_stand_in_few_blocks(spark):
    """A report is repeated for its figures at most, not for every word with all its words."""
    one = spark.sql(f"SELECT {LONG}")
    assert one.select(*(F.size(rule.keys) for rule in event() + talk())).first() == (1,) * 5


def test_other_columns_of_a_pair(spark):
    c = spark.createDataFrame([("a", 0, ["x", "y"]), ("b", 5, ["y", "z"]), ("c", 9, None)], "fp string, at long, w array<string>")
    rule = Rule("any", 10, F.array(F.lit("k")), F.col("at") >= 0)
    got = {tuple(r) for r in matches(c, [rule], then=F.col("at_e"), hits=F.size(F.array_intersect("w", "w_e"))).select("early", "late", "then", "hits").collect()}
    assert got == {("a", "b", 0, 1), ("a", "c", 0, None), ("b", "c", 5, None)}


@pytest.mark.parametrize("least", [2, 3])
def test_tellers_stand_in_few_blocks(spark, sf_dir, monkeypatch, least):
    rules = []
    monkeypatch.setattr(wording, "matches", lambda c, r, **more: rules.extend(r) or matches(c, r, **more))
    wording._tellers(spark, sf_dir, least, F.lit(True))
    one = spark.sql(f"SELECT {LONG}")
    assert [one.select(F.size(r.keys)).first()[0] for r in rules] == [1]


def test_first_targets_meet_by_desk(spark):
    from tideline.plans.marks import first_targets

    rows = [(1, 0, "fr", ["aaaaa", "bbbbb"]), (2, 86_400, "fr", ["bbbbb", "aaaaa"]), (3, 86_401, "fr", ["aaaaa", "bbbbb", "ccccc"]), (4, 86_401, "de", ["aaaaa", "bbbbb"]), (5, 0, None, ["aaaaa", "bbbbb"]), (6, 9, None, ["aaaaa", "bbbbb"]), (7, 0, "fr", ["aaaaa"])]
    got = first_targets(spark.createDataFrame(rows, "doc_id int, at long, desk string, w array<string>"))
    assert sorted(map(tuple, got.collect())) == [(2, 1, 0), (3, 2, 86_400)]  # where pairs of words were the keys, 6 was given 5
