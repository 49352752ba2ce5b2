"""Aligned tokens against the libraries' own encoders and every pair of spans."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tideline.llm import queries
from tideline.llm import token_alignment as A


@pytest.fixture(scope="module")
def own():
    return A.Encoder(A.vocabularies())


@pytest.fixture(scope="module")
def plain(own):
    """Ids, sorted links and groups of a text, by whole-text encoding with the dealt files."""
    hf = Tokenizer.from_file(A.BYTE_BPE)
    hf.encode_special_tokens = True

    def aligned(text):
        if not text:
            return [], [], [], []
        a, b, raw = hf.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text), (" " + text).encode()
        ba, bb = [own.bytes_a[k] if k < len(own.bytes_a) else b"?" for k in a], [own.bytes_b[k] for k in b]
        if b"".join(ba) != raw or b"".join(bb) != raw:
            return [], [], [], []
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        links, first = [], 0
        for i in range(len(a)):
            while eb[first] <= sa[i]:
                first += 1
            j = first
            while j < len(b) and sb[j] < ea[i]:
                links.append((a[i], b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for end in sorted({*ea} & {*eb}):
            k, m = i, j
            while i < len(a) and ea[i] <= end:
                i += 1
            while j < len(b) and eb[j] <= end:
                j += 1
            groups.append(",".join(map(str, a[k:i])) + "|" + ",".join(map(str, b[m:j])))
        return a, b, sorted(links), groups

    return aligned


def test_odd_texts(own, plain):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "the", " foo", "é", "ß", "☃", "👍🏽", "▁", "　", "0", "12", "'s", "...", "\x00", "\x1c", "\x85", "<s>", "<unk>", "<0x41>", "<|endoftext|>", "\r\n", "中文", "​"]
    texts = [None, "", " ", "  ", "a ", " a", "\n ", " \n", "\0", "\0 a", "</s> x", "x" * 3000, " " * 3000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for k in range(0, len(texts), 500):
        some = texts[k : k + 500]
        x = A.align(own, some)
        written, many = A.group_texts(own, x, len(some))
        for d, t in enumerate(some):
            at = x.doc_a[x.link_a] == d
            links = sorted(zip(x.ids_a[x.link_a[at]].tolist(), x.ids_b[x.link_b[at]].tolist()))
            a, b, all_links, groups = plain(t)
            assert (x.ids_a[x.doc_a == d].tolist(), x.ids_b[x.doc_b == d].tolist(), links, written[d], many[d]) == (a, b, all_links, ";".join(groups), len(groups)), t


def corpus(docs, plain):
    """The query's rows by the contract's own words."""
    found = [(i, *plain(t)) for i, t in docs]
    count = Counter(p for *_, links, _ in found for p in set(links))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for i, a, b, links, groups in found:
        text = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), text


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query(spark, sf_dir, plain):
    docs = duckdb.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    rows = queries.op12_token_alignment(spark, sf_dir).select(NAMES).collect()
    assert sorted(map(tuple, rows)) == sorted(corpus(docs, plain))


@pytest.mark.parametrize("most_common", [0, 3, 1 << 20])
def test_rare_and_common_pairs_count_alike(spark, plain, most_common):
    rows = [(k, f"the cat no {k % 7} sat on mat{k % 3}!") for k in range(60)] + [(None, "nobody"), (7, "twice"), (7, "twice"), (8, None), (9, ""), (10, "▁ not spelt back"), (11, "long " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = A.cross_align(spark, docs.selectExpr("*", "1 as n_a", "2 as extra"), keep=["doc_id", "n_a"], digest=True, most_common=most_common)
    got = found.documents.withColumnRenamed("groups", "groups_sha256").select(NAMES).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, corpus(rows, plain)))
    assert {(r.a, r.b): r.docs for r in found.pairs.collect()} == Counter(p for _, t in rows for p in set(plain(t)[2]))


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.cross_align(spark, docs).documents.count() == 0
