"""Periodic runs against every stretch of every period, and the query against plain Python over the whole table."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import periodic_runs, queries


def all_runs(w, least=6, exponent=4):
    """By walking along every period; a stretch belongs to its smallest one."""
    smallest = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                smallest.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in smallest.items())


@pytest.mark.parametrize("least, exponent", [(6, 4), (4, 2), (8, 3), (1, 5)])
def test_runs_of_random_sequences(least, exponent):
    rng = random.Random(least * 10 + exponent)
    for _ in range(1500):
        n, kinds = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(kinds) for _ in range(n)]
        if n > 10 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 9)
            w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
        assert periodic_runs.runs_of(np.array(w, np.int64), least, exponent) == all_runs(w, least, exponent), w


def test_long_texts_take_no_square_of_time():
    for w in (np.zeros(100_000, np.int64), np.tile(np.arange(500), 200), np.arange(100_000) % 2):
        assert len(periodic_runs.runs_of(w)) == 1
    assert periodic_runs.runs_of(np.arange(100_000)) == []


def planted(doc_id, text):
    words, h = [w for w in (text or "").encode().split()], zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_query(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    docs, some = duckdb.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall(), 0
    assert len(rows) == len(docs)
    for i, text in docs:
        words, r = planted(i, text), rows[i]
        runs = all_runs(words)
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        some += bool(runs)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        left = b" ".join(w for k, w in enumerate(words) if k not in dropped)
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), s, n, q, runs and 1000 * n // q or None)
        assert (r.runs_sha256, r.collapsed_sha256) == (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
    assert some > 10


def test_odd_rows(spark):
    rows = [(0, None, 1), (1, "", 2), (2, " \n\t", 3), (None, "a b " * 20, 4), (3, "x " * 5, 5), (3, "x " * 6, 6), (3, "x " * 6, 6), (4, "word " * 200_000, 7), (5, "a a a a", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    out = periodic_runs.detect_runs(spark, docs)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed_text"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in out.collect()]
    want = [(0, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (None, 40, [(0, 40, 2)], "a b"), (3, 5, [], "x x x x x"), (3, 6, [(0, 6, 1)], "x"), (3, 6, [(0, 6, 1)], "x"),
            (4, 200_000, [(0, 200_000, 1)], "word"), (5, 2, [], "a a a a")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs.detect_runs(spark, docs.limit(0)).count() == 0
    same = docs.select("doc_id", "text", periodic_runs.with_planted_runs(F.col("doc_id"), F.col("text")).alias("t")).filter("doc_id is null or text is null or trim(text) = ''")
    assert all(r.t == r.text for r in same.collect())
