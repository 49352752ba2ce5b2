"""The registered queries on the smallest tables: against their SQL, or against what a plain pass over the rows says."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken

from tests.test_queries import TABLES, plain
from tideline.llm import queries, token_counts


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    out = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in out.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got = df.select(columns).collect()
    assert sorted(repr(plain(tuple(r))) for r in got) == sorted(repr(plain(r)) for r in out.fetchall())


def test_every_operator_is_registered_once():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def test_fingerprints(spark, sf_dir, duck):
    rows, docs = {r.doc_id: r for r in queries.op2_imatch(spark, sf_dir).collect()}, texts(duck)
    ids = sorted(docs, reverse=True)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t = docs[i]
        edited = t[: len(t) - len(t) // 2] + docs[nxt][: len(t) // 2]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert len({(docs[i], r.fingerprint) for i, r in rows.items()}) == len(set(docs.values()))
    assert np.mean([r.near_edited for r in rows.values()]) > 10 * np.mean([r.near_next for r in rows.values()])


def test_line_dedup_keeps_first_occurrences(spark, sf_dir, duck):
    rows, docs = {r.doc_id: r for r in queries.op3_line_dedup(spark, sf_dir).collect()}, texts(duck)
    seen = set()
    for i in sorted(docs):
        lines = docs[i].split("\n")
        fresh = not any(x.strip() in seen for x in lines if x.strip())
        assert rows[i].n_lines == len(lines)
        if fresh:
            assert rows[i].n_removed == 0 and rows[i].clean_sha256 == hashlib.sha256(docs[i].encode()).hexdigest()
        seen |= {x.strip() for x in lines}
    assert sum(r.n_removed for r in rows.values()) > 0


def test_token_histogram(spark, sf_dir, duck):
    encode = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts._ranks(token_counts.TOKENIZER), special_tokens={}).encode_ordinary
    n = np.array([len(encode(t)) for t in texts(duck).values()])
    rows = queries.op5_token_counts(spark, sf_dir).collect()
    assert {r.length: r.n_docs for r in rows} == dict(zip(*map(list, np.unique(n, return_counts=True))))
    assert all(r.truncated_total == np.minimum(n, r.length).sum() for r in rows)


def test_classifiers_on_held_out_rows(spark, duck):
    sf = "/root/testdata/sf0.01"
    lang = dict(duck.execute(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    judged = [r for r in queries.op8_language_id(spark, sf).collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in judged)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in judged]) > 0.95
    toxic = dict(duck.execute(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    judged = [r for r in queries.op7_toxicity(spark, sf).collect() if r.doc_id in toxic and r.held_out]
    assert np.mean([toxic[r.doc_id] == r.predicted for r in judged]) > 0.9 and all((r.score >= 0.5) == r.predicted for r in judged)
