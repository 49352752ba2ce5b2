"""The pipeline, stage by stage and as a whole, against a plain version."""

import hashlib
import random

import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_decontaminate import words
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_others import fill

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    own = {"aa": ["thing", "ation", "heres", "ough", "with"], "bb": ["chung", "keit", "schaft", "lich", "gen"]}
    word = lambda k: "".join(rng.choice(own[k]) for _ in range(rng.randint(1, 3))) + rng.choice("abcdef")
    line = lambda k, n=14: " ".join(word(k) for _ in range(n))
    rows = [(i, "\n".join(line(k) for _ in range(rng.randint(3, 8))), k, f"src{i % 3}") for i in range(40) for k in [rng.choice(["aa", "bb"])]]
    passage = line("aa", 60)
    rows += [(i, f"{line('aa')}\n{passage}\n{line('aa')}", "aa", "src0") for i in range(40, 46)]
    rows += [(i, rows[3][1], "aa", "src1") for i in range(46, 49)]  # exact copies
    near = rows[5][1].replace("\n", " ").split()
    rows += [(i, " ".join(w if k != i else "changed" for k, w in enumerate(near)), rows[5][2], "src2") for i in range(49, 55)]
    item = line("aa", 25)
    rows += [(55, f"{line('aa')} {item} {line('aa')}", "aa", None), (56, item, "aa", "src0"), (57, "123 456 !!", "aa", "src0"), (58, None, None, None), (59, "", "bb", "src1")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, k, s, len(t or "")) for i, t, k, s in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, line("bb", 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, [(1, item), (2, None)]


def plain_lines(rows, least=10):
    """Common lines stand in the same order in these documents, so an alignment is all of them."""
    first, out = {}, {}
    for i, t in sorted(rows):
        for line in (t or "").split("\n"):
            if line.strip():
                first.setdefault(line.strip(), i)
    texts = dict(rows)
    for i, t in sorted(rows):
        own, gone = (t or "").split("\n"), set()
        for home in {first[x.strip()] for x in own if x.strip()} - {i}:
            there = [x.strip() for x in texts[home].split("\n")]
            run, last = [], None
            for k, x in [*enumerate(own), (len(own), None)]:
                at = there.index(x.strip()) if x and x.strip() in there else None
                if at is None or (last is not None and at != last + 1):
                    gone |= set(run) if sum(len(own[j].split()) for j in run) >= least else set()
                    run = []
                if at is not None:
                    run.append(k)
                last = at
        kept = "\n".join(x for k, x in enumerate(own) if k not in gone)
        if not gone or kept.strip():
            out[i] = kept if gone else t
    return out


def test_each_stage_and_the_whole(spark, corpus):
    folder, rows, items = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema if name != "mixing" else "doc_id long, source string, size long, target double, taken long")
        seen.append({r.doc_id: r for r in docs.collect()})
    language, lines, near, clean, mix = seen
    assert set(language) == {r[0] for r in rows} - {57, 58, 59}  # clear texts stay, those without letters go

    want = plain_lines([(i, r.text) for i, r in language.items()])
    assert {i: r.text for i, r in lines.items()} == want and not {46, 47, 48} & set(lines) and all(r.n_chars == len(r.text) for r in lines.values())
    assert sum("\n" in r.text for i, r in lines.items() if 40 <= i < 46) == 6

    want = {i for i, (_, home, _) in groups([(i, r.text) for i, r in lines.items()]).items() if i == home}
    assert set(near) == want and not set(range(49, 55)) & set(near)

    found = leaks([(i, r.text) for i, r in near.items()], [items[0]])
    assert set(clean) == {i for i, (n, hit, _) in found.items() if hit < n} and 55 in clean and 56 not in clean
    assert all(r.text == near[i].text for i, r in clean.items() if not found[i][1])
    assert not any(hit for _, hit, _ in leaks([(i, r.text) for i, r in clean.items()], [items[0]]).values())

    sizes, order = {}, {}
    for r in clean.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
        order.setdefault(r.source, []).append((hashlib.md5(f"mix:{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest(), r.doc_id, len(r.text.split())))
    goal = fill(sizes, (5, 2, 1))
    copies = []
    for source, queue in order.items():
        done = 0
        for turn in range(3):
            for k, i, n in sorted(queue):
                done += n
                copies.append((done / mix[i].target, source is None, source or "", k, n, turn, i))
                assert mix[i].size == n and abs(mix[i].target - goal[source]) < 1e-6
    left, taken = sum(sizes.values()), dict.fromkeys(mix, 0)
    for *_, n, _, i in sorted(copies):
        taken[i] += min(n, left)
        left -= min(n, left)
    assert {i: r.taken for i, r in mix.items()} == taken and left == 0
    assert {r.doc_id: tuple(r) for r in corpus_pipeline.run(spark, folder).collect()} == {i: tuple(r) for i, r in mix.items()}
    assert words(clean[55].text) and "changed" not in clean[55].text


def test_rows_of_one_id_and_empty_tables(spark, corpus):
    folder, _, _ = corpus
    words_of = lambda k, n=30: " ".join(f"{k}{x}" for x in range(n))
    rows = [(1, words_of("a"), "aa", "s", 1), (1, words_of("b"), "aa", "s", 1), (1, words_of("a"), "aa", "r", 1), (2, words_of("b") + " end", "aa", "s", 1), (2, words_of("c"), "aa", "s", 1)]
    rows += [(3, None, None, None, 0), (3, "", None, None, 0), (None, words_of("a"), "aa", "s", 1), (None, words_of("a"), "aa", "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, folder).collect()]
    assert sorted(kept, key=repr) == sorted([rows[2], rows[1], rows[4], *rows[5:]], key=repr)
    again = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs.repartition(3), folder).collect()]
    assert sorted(again, key=repr) == sorted(kept, key=repr)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.filter("false").withColumn("taken", docs.n_chars), folder)
        assert out.collect() == [] and (name == "mixing" or out.columns == [*docs.columns, "taken"])
