import random

from tideline.llm.line_dedup import dedup_lines, patience, removed_lines, run_keys


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(12) for _ in range(rng.randrange(15))], [rng.randrange(12) for _ in range(rng.randrange(15))]
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < y and z < w for (x, z), (y, w) in zip(got, got[1:]))
        assert len(got) <= longest_common(a, b)
    unique = random.Random(2).sample(range(50), 20), random.Random(3).sample(range(50), 20)
    assert len(patience(*unique)) == longest_common(*unique)


def test_blocks_need_enough_words():
    shared = [(4, [0], [5]), (4, [1], [6]), (4, [9], [9])]
    assert removed_lines(shared, 8) == [5, 6] and removed_lines(shared, 9) == []


def clean(spark, rows, **options):
    return {r.doc_id: r for r in dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}


LONG = "one two three four five six seven eight nine ten eleven"


def test_later_documents_lose_common_blocks(spark):
    rows = [(1, f"top\n{LONG}\nmid\nend"), (2, f"other\n {LONG} \ntail"), (3, f"{LONG}"), (4, "end"), (5, "mid\nend"), (6, f"x\n{LONG}\n{LONG}")]
    got = clean(spark, rows)
    assert {k: r.clean_text for k, r in got.items()} == {1: rows[0][1], 2: "other\ntail", 3: "", 4: "end", 5: "mid\nend", 6: f"x\n{LONG}"}
    assert {k: r.n_removed for k, r in got.items()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1}


def test_short_lines_count_together(spark):
    verse = "\n".join(f"line {i} of it" for i in range(5))
    got = clean(spark, [(1, "a\n" + verse), (2, "b\n" + verse + "\nc"), (3, "line 2 of it\nb2")])
    assert got[2].clean_text == "b\nc" and got[3].n_removed == 0


def test_runs_in_another_order_go(spark):
    p, q = LONG, LONG.replace("one", "uno")
    got = clean(spark, [(1, f"{p}\n{q}"), (2, f"{q}\n{p}"), (3, f"{q}\n{p}")])
    assert {k: r.clean_text for k, r in got.items()} == {1: f"{p}\n{q}", 2: "", 3: ""}
    assert sorted(removed_lines([(4, [3, 8], [1, 5]), (4, [4, 9], [2, 6])], 8)) == [1, 2, 5, 6]
    assert sorted(removed_lines([(9, [2], [0]), (3, [0], [1]), (3, [1], [2])], 8)) == [0]


def test_a_block_whose_lines_are_known_apart_goes(spark):
    a, b = "a1 a2 a3 a4 a5 a6", "b1 b2 b3 b4 b5 b6"
    got = clean(spark, [(1, f"{a}\nx"), (2, f"y\n{b}"), (3, f"z\n{a}\n{b}"), (4, f"{a}\n{b}\nw"), (5, f"{LONG}\nv"), (6, f"u\n{LONG}\nm\n{LONG}"), (7, f"{LONG}\nt\n{LONG}")])
    assert {k: got[k].clean_text for k in (3, 4, 6, 7)} == {3: f"z\n{a}\n{b}", 4: "w", 6: f"u\nm\n{LONG}", 7: "t"}


def test_run_keys_cover_every_shared_run():
    rng = random.Random(4)
    for _ in range(100):
        n = [rng.choice([2, 5, 11]) for _ in range(6)]
        x, y = [rng.randrange(6) for _ in range(12)], [rng.randrange(6) for _ in range(12)]
        keys = [{key for key, _ in run_keys([(k, n[k], [i for i, v in enumerate(z) if v == k]) for k in set(z)], 10)} for z in (x, y)]
        common = any(x[i : i + m] == y[j : j + m] and sum(n[v] for v in x[i : i + m]) >= 10 for m in range(1, 7) for i in range(13 - m) for j in range(13 - m))
        assert bool(keys[0] & keys[1]) == common


def test_nulls_empty_and_repeated_rows(spark):
    rows = [(None, LONG), (1, None), (2, ""), (3, LONG), (3, LONG), (4, LONG)]
    out = dedup_lines(spark, spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_lines int")).collect()
    assert sorted(((r.doc_id, r.clean_text, r.n_removed) for r in out), key=repr) == sorted([(None, LONG, 0), (1, None, 0), (2, "", 0), (3, LONG, 0), (3, LONG, 0), (4, "", 1)], key=repr)
    assert dedup_lines(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_frequent_block_stays_in_the_first_only(spark):
    got = clean(spark, [(i, f"own {i}\n{LONG}") for i in range(300)])
    assert got[0].n_removed == 0 and all(r.clean_text == f"own {k}" for k, r in got.items() if k)


def all_pairs(rows, least):
    """Every later document aligned with every earlier one; how many lines go in any of the pairs."""
    lines = {i: [x.strip() for x in t.split("\n")] for i, t in rows}
    gone = {i: set() for i in lines}
    for i in lines:
        for j in (j for j in lines if j < i):
            both = sorted((set(lines[i]) & set(lines[j])) - {""})
            places = lambda k, x: [p for p, y in enumerate(lines[k]) if y == x]
            gone[i] |= set(removed_lines([(len(x.split()), places(j, x), places(i, x)) for x in both], least))
    return {i: len(x) for i, x in gone.items()}


def test_as_complete_as_all_pairs(spark):
    # Documents in which no line repeats. Of a passage that repeats in a document as many stay as no one earlier document has.
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        pool = [" ".join(f"{k}w{x}" for x in range(rng.choice([3, 6, 12]))) for k in range(60)]
        passages = [rng.sample(pool, rng.randint(1, 4)) for _ in range(8)]
        rows = []
        for i in range(60):
            text = []
            for _ in range(rng.randint(1, 5)):
                part = rng.choice([rng.choice(passages), [rng.choice(pool)], [f"own {i} {rng.random()}"], [""]])
                text += part if part == [""] or not set(part) & set(text) else []
            rows.append((i, "\n".join(text)))
        want = all_pairs(rows, 10)
        assert {k: r.n_removed for k, r in clean(spark, rows).items()} == want and sum(want.values()) > 50
