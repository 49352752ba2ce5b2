"""The cascade: verdicts do not depend on the order, the order is the greedy one, and a text stops at its first rejection."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.llm import quality_rules as Q


def test_order_is_by_rejections_per_cost():
    sets = Counter({frozenset("ab"): 50, frozenset("b"): 10, frozenset("c"): 30, frozenset(): 100})
    # a: 50 / 1, b: 60 / 2, c: 30 / 1; after a, b rejects only 10 more for 2.
    assert Q.order_rules(sets, {"a": 1.0, "b": 2.0, "c": 1.0, "d": 0.1}, list("abcd")) == ["a", "c", "b", "d"]
    assert Q.order_rules(Counter(), {"x": 2.0, "y": 1.0}, ["x", "y"]) == ["y", "x"]


def test_a_text_stops_at_its_first_rejection():
    asked = []
    rules = (Q.Rule("cheap", ("n_words",), lambda n: n < 3), Q.Rule("dear", ("n_lettered",), lambda n: asked.append(n) or n == 0))
    t = Q.Text(b"a b")
    assert next(r.name for r in rules if r(t)) == "cheap" and not asked and "n_lettered" not in t.taken
    assert next((r.name for r in rules if r(Q.Text(b"1 2 3 4"))), None) == "dear" and asked == [0]


@pytest.mark.parametrize("raw, n, chars, symbols, dup, repeat", [
    (None, 0, 0, 0, 0, 0), (b"", 0, 0, 0, 0, 0), (b" \n \n", 0, 0, 0, 0, 0), ("é ß x\n".encode(), 2, 4, 0, 0, 0), (b"a#b\n%\na#b\n%\n\n\n", 4, 8, 4, 2, 0),
    (b"a b c a b c", 6, 6, 0, 0, 6), (b"a a a a", 4, 4, 0, 0, 4), (b"x a b c y a b c z", 9, 9, 0, 0, 6), (b"a b c", 3, 3, 0, 0, 0),
])
def test_measures(raw, n, chars, symbols, dup, repeat):
    t = Q.Text(raw)
    assert tuple(t[m] for m in Q.BASE) == (n, chars, symbols, dup, repeat)


def test_windows_of_very_many_words():
    """Numbers of windows that do not fit 64 bits are renamed first."""
    words = [b"%d" % k for k in range(60_000)]
    assert Q._repeat_words(Q.Text(b" ".join(words)), n=5) == 0 and Q._repeat_words(Q.Text(b" ".join(words + words[:7])), n=5) == 14


def test_verdicts_do_not_depend_on_the_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(1).alias("kept"), F.lit("x").alias("n_words"))
    own = Q.plan(spark, docs, always=Q.BASE)
    assert sorted(own.order) == sorted(r.name for r in Q.RULES) and all(c > 0 for c in own.cost.values()) and own.share["repeated windows"] > 0
    turned = Q.Plan(own.order[::-1])
    a, b = (Q.judge(spark, docs, p, always=Q.BASE).collect() for p in (own, turned))
    assert [r.kept for r in a] == [r.kept for r in b] and any(x.rejected_by != y.rejected_by for x, y in zip(a, b))
    assert all(r.kept == (r.rejected_by is None) for r in a) and 0.5 < sum(r.kept for r in a) / len(a) < 0.95


def test_odd_rows(spark):
    long = " ".join(f"word{k} und" for k in range(60_000))
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b c " * 30), (3, long), (3, long)], "doc_id long, text string")
    out = {(r.doc_id, r.n_words): r.kept for r in Q.judge(spark, docs, Q.plan(spark, docs), always=("n_words",)).collect()}
    assert out == {(1, 0): False, (2, 0): False, (None, 90): False, (3, 120_000): True}
    nothing = docs.limit(0)
    assert Q.judge(spark, nothing, Q.plan(spark, nothing), always=Q.BASE).count() == 0
