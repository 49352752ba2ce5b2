import random
import re

import pytest

from tideline.llm import ngram_join
from tideline.llm.ngram_join import ngram_jaccard_join

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=80):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, links = sorted(sets), dict.fromkeys(sets, 0)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_jaccard_join(spark, docs, **options).documents.collect()
    return out, {r.id: (r.n_tokens, r.component, r.n_links) for r in out}


def test_near_copies_chains_and_hot_passages(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(60):  # a group of near copies
        t = base[:]
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append((i, " ".join(t)))
    for i in range(60, 90):  # a passage that many share, mostly below the threshold
        rows.append((i, " ".join(shared + [rng.choice(vocabulary) for _ in range(rng.randint(2, 14))])))
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for i in range(90, 110):  # each like its neighbours only
        chain = chain[4:] + [rng.choice(vocabulary) for _ in range(4)]
        rows.append((i, " ".join(chain)))
    for i in range(110, 130):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))))
    rng.shuffle(rows)
    assert run(spark, rows)[1] == brute(rows)


@pytest.mark.parametrize("block, seed", [(512, 1), (4, 2)])
def test_numbers_of_links_in_groups_of_copies_of_copies(spark, monkeypatch, block, seed):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for size in (40, 90):
        texts = [[rng.choice(vocabulary) for _ in range(size)]]
        for _ in range(90):  # copies of copies, with words replaced, left out, put in and put at the end
            t = rng.choice(texts)[:]
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 1)] = rng.sample(vocabulary[:20], rng.randint(0, 1))
            texts.append(t + rng.sample(vocabulary[:8], rng.randint(0, 2)))
        rows += [" ".join(t) for t in texts]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert run(spark, rows)[1] == brute(rows)


def test_short_empty_equal_and_null_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (7, "a b c d e"), (8, "É é"), (9, "é é"), (None, "a b c d e")]
    out, got = run(spark, rows)
    assert got == brute([r for r in rows if r[0] is not None]) | {None: (1, None, 0)}
    assert got[1] == (0, 1, 0) and got[5] == (1, 4, 1) and got[7] == (1, 6, 1) and got[9] == (1, 9, 0)


def test_repeated_rows_and_empty_table(spark):
    out, _ = run(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])
    assert sorted((r.id, r.component) for r in out) == [(1, 1), (1, 1), (2, 1)]
    assert run(spark, [])[0] == []


@pytest.mark.parametrize("common, linked", [(8, True), (7, False)])
def test_threshold_is_inclusive(spark, common, linked):
    # One shares 8 of 10 tokens of the union (linked), the other 7 of 10 or fewer.
    a = [f"a{i}" for i in range(common + 4)]
    rows = [(1, " ".join(a)), (2, " ".join(a + ["x", "y"] if linked else a + ["x", "y", "z"]))]
    assert brute(rows)[2][1] == (1 if linked else 2)
    assert run(spark, rows)[1] == brute(rows)


def test_very_long_text_and_extra_columns(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(30_000))
    docs = spark.createDataFrame([(1, long, 1, 2), (2, long + " end", 1, 2)], "doc_id long, text string, sig int, n int")
    found = ngram_jaccard_join(spark, docs)
    assert {r.component for r in found.documents.collect()} == {1} and found.links.count() == 1
