import random
import re

import numpy as np

from tideline.llm.decontaminate import decontaminate
from tideline.llm.fm_index import FMIndex, suffix_array

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(t):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items, window=10):
    phrases = {}
    for item, t in items:
        w = words(t)
        for a in range(len(w) - min(window, len(w)) + 1 if w else 0):
            phrases.setdefault(tuple(w[a : a + min(window, len(w))]), set()).add(str(item))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for p, names in phrases.items():
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a : a + len(p)]) == p:
                    hit |= set(range(a, a + len(p)))
                    found |= names
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_index_against_a_plain_search():
    rng = np.random.default_rng(4)
    segments = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(12)]
    seq = np.concatenate([np.r_[s, 0] for s in segments])
    order = suffix_array(seq)
    assert sorted(order) == list(range(len(seq)))
    index = FMIndex(seq, 3)
    for k in (1, 2, 5):
        patterns = np.array([rng.integers(1, 4, k) for _ in range(20)])
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            want = [i for i in range(len(seq) - k + 1) if (seq[i : i + k] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in decontaminate(spark, d, b, **options).collect()}


def test_brute_force_in_one_and_in_many_blocks(spark):
    rng = random.Random(9)
    v = [f"v{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([1, 3, 5, 6, 9])))) for i in range(3, 12)] + [(90, None), (91, "..."), (None, "v1 v1 v2 zz")]
    docs = [(i, " ".join(rng.choice([*v, *v, "Other", "É"]) for _ in range(rng.randrange(60)))) for i in range(40)]
    want = brute(docs, [x for x in items if x[0] is not None], 5)
    for options in ({}, {"block_words": 8}):
        got = run(spark, docs, [x for x in items if x[0] is not None], window=5, **options)
        assert {k: (r.n_words, r.n_hit, list(r["items"])) for k, r in got.items()} == want


def test_spans_are_cut_out(spark):
    got = run(spark, [(1, "Before, a b C! After"), (2, "a b"), (3, None), (4, ""), (5, "a b c")], [(7, "a b c")])
    assert {k: r.clean_text for k, r in got.items()} == {1: "Before, ! After", 2: "a b", 3: None, 4: "", 5: ""}
    assert list(got[1].spans) == [1, 4] and list(got[1]["items"]) == ["7"] and got[3].n_words == 0


def test_nothing_to_look_for_and_empty_tables(spark):
    assert run(spark, [(1, "a b")], [])[1].n_hit == 0 and run(spark, [], [(1, "a")]) == {}
    d = spark.createDataFrame([(1, "x a", 5), (1, "x a", 5)], "doc_id long, text string, items int")
    out = decontaminate(spark, d, spark.createDataFrame([(None, "a")], "item_id long, text string")).collect()
    assert [(r.n_hit, list(r["items"]), r.clean_text) for r in out] == [(1, [], "x ")] * 2
