"""Fingerprints, URL templates, token counts, toxicity, language ID, revisits, mixing."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from tideline.llm import imatch, language_id, mixing, queries, token_counts, toxicity, url_templates, warc
from tideline.llm.scan import NOT_SPACE, mix, scan


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Fingerprints


def test_fingerprints_and_edited_texts(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(30))) for i in range(12)] + [(20, None), (21, ""), (22, rng.choice("é") * 7), (23, "same text"), (24, "same text")]
    docs = frame(spark, rows, "doc_id long, text string")
    out = {r.id: r for r in imatch.with_next(spark, docs, imatch.lexicon(spark, docs, least_idf=0.1)).collect()}
    ids = sorted(out, reverse=True)
    texts = {i: t or "" for i, t in rows}
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t = texts[i]
        edited = t[: len(t) - len(t) // 2] + texts[nxt][: len(t) // 2]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and r.near_next == imatch.likeness(r.fingerprint, out[nxt].fingerprint)
        if edited == t:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    assert out[23].fingerprint == out[24].fingerprint and out[24].near_next == 1


def test_fingerprints_of_nothing(spark):
    none = frame(spark, [], "doc_id long, text string")
    own = imatch.lexicon(spark, none)
    assert len(own.terms) == 0 and imatch.with_next(spark, none, own).collect() == []
    one = imatch.with_next(spark, frame(spark, [(1, "a b")], "doc_id long, text string"), own).collect()
    assert [(r.id, r.near_next) for r in one] == [(1, 1.0)]
    twice = frame(spark, [(1, "a b", "x"), (1, "a b", "x"), (None, None, "x")], "doc_id long, text string, fingerprint string")
    assert len({r.fingerprint for r in imatch.fingerprints(spark, twice, own).collect()}) == 2


def test_lexicon_is_refused_beyond_its_size(spark):
    docs = frame(spark, [(i, f"common{i % 3} pair{i % 20}") for i in range(60)], "doc_id long, text string")
    assert len(imatch.lexicon(spark, docs, least_idf=0.0).terms) == 23
    with pytest.raises(ValueError):
        imatch.lexicon(spark, docs, least_idf=0.0, most_terms=3)


def test_fingerprints_against_plain_sets(spark):
    rng = random.Random(3)
    words = [f"Word{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words[: 5 + 5 * (i % 11)]) for _ in range(rng.randint(0, 40))) for i in range(80)]
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    own = imatch.lexicon(spark, docs, least_idf=0.5, most_idf=3.0)
    sets = [set(t.lower().split()) for t in texts]
    df = Counter(w for x in sets for w in x)
    band = {w for w, c in df.items() if 0.5 <= math.log(len(texts) / c) <= 3.0 and c >= 2}
    code = {w: int(next(scan(pa.array([w]), NOT_SPACE))[1].hashes[0]) for w in df}
    assert {code[w] for w in band} == set(own.terms.tolist()) and 10 < len(band) < len(df)
    # Subset k holds a term if its hash for k is under the rate; texts agree in k just when they keep the same terms of it.
    holds = lambda w, k: int(mix(np.array([code[w]], np.uint64) ^ mix(np.array([k + 1], np.uint64)))[0]) < int(imatch.RATES[k] * (1 << 64))
    subsets = [{w for w in band if holds(w, k)} for k in range(len(imatch.RATES))]
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprints(spark, docs, own).collect()}
    for a in range(0, 80, 7):
        for b in range(80):
            if sets[a] & band and sets[b] & band:
                used = [k for k, x in enumerate(subsets) if (sets[a] | sets[b]) & x]
                same = sum((sets[a] & subsets[k]) == (sets[b] & subsets[k]) for k in used)
                assert imatch.likeness(prints[a], prints[b]) == (same / len(used) if used else float(sets[a] & band == sets[b] & band))
                assert (prints[a] == prints[b]) == (sets[a] & band == sets[b] & band)


def test_fingerprints_of_few_terms_differ(spark):
    """Texts of one to five terms, in the lexicon or not: equal prints just for equal sets, whatever subsets hold them."""
    rng = random.Random(31)
    words = [f"w{k}" for k in range(700)]
    texts = [" ".join(rng.sample(words, rng.randint(1, 5))) for _ in range(1500)] + words + ["", " ", "\n", None, "only here", "here only", "ONLY  here", "other one"]
    texts += [" ".join(words), " ".join(words[::-1])]
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    own = imatch.lexicon(spark, docs, least_idf=0.5, most_idf=7.0)
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprints(spark, docs, own).collect()}
    sets = [frozenset((t or "").lower().split()) for t in texts]
    assert len(own.terms) == 702  # "only" and "here" are in three texts
    by_set, by_print = defaultdict(set), defaultdict(set)
    for i, x in enumerate(sets):
        by_set[x].add(prints[i])
        by_print[prints[i]].add(x)
    assert all(len(x) == 1 for x in by_set.values()) and all(len(x) == 1 for x in by_print.values())
    few = [i for i, x in enumerate(sets) if len(x) == 1]
    assert all(imatch.likeness(prints[i], prints[j]) == float(sets[i] == sets[j]) for i in few[:60] for j in few)


# URL templates


def test_url_parts_and_rules(spark):
    urls = [(1, "HTTP://A.Example.COM/en/7?x://y"), (2, "https://example.com"), (3, None), (4, "/no/scheme"), (5, "x://h#f/en/"), (6, "https://notexample.com/en/7"), (7, "https://b.de/en/"), (8, "x://\n.NET/de/8")]
    pages = frame(spark, urls, "page_id long, url string")
    labelled = frame(spark, [], "page_id long, good boolean")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(spark, pages, labelled, queries.URL_RULES).collect()}
    assert out[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert out[2] == ("example.com", "", None, "allow") and out[3] == out[4] == ("", "", None, "allow")
    assert out[5] == ("h", "", None, "allow") and out[6][2:] == ("com/en/", "block") and out[7][2] is None and out[8][2:] == ("net/de/", "allow")


def test_bad_templates_are_rejected_and_wildcards_found(spark):
    rows = [(i, f"https://h.org/shop/item-{i}x/{i}") for i in range(40)] + [(100 + i, f"https://h.org/news/{w}/a") for i, w in enumerate("abcdefghijklmnopqrstuvwxyz")]
    labels = [(i, False) for i in range(20)] + [(100 + i, True) for i in range(10)]
    out = url_templates.judge(spark, frame(spark, rows, "page_id long, url string"), frame(spark, labels, "page_id long, good boolean"), []).collect()
    by = {r.page_id: r for r in out}
    assert by[30].verdict == "block" and by[30].template == by[0].template and by[120].verdict == "allow"
    assert by[100].template == by[125].template and len({r.template for r in out}) == 2
    assert url_templates.judge(spark, frame(spark, [], "page_id long, url string"), frame(spark, [], "page_id long, good boolean"), []).collect() == []


def test_deep_sections_are_told_apart(spark):
    rows = [(k, f"https://h.org/en/2024/05/{'offers' if k < 20 else 'news'}/{k}/view/{w}") for k in range(40) for w in "ab"] + [(100, "x://d/" + "a/" * 300), (100, "x://d/" + "b/" * 40), (101, "x://e/" + "a/" * 300)]
    labels = [(k, k >= 20) for k in range(0, 40, 2)] + [(101, True)]
    out = url_templates.judge(spark, frame(spark, rows, "page_id long, url string"), frame(spark, labels, "page_id long, good boolean"), []).collect()
    assert len(out) == 83 and all((r.verdict == "block") == (r.page_id < 20) for r in out) and {r.page_id: r.template for r in out if r.page_id >= 100} == {100: "/**", 101: "/a" * 300}


def test_url_query_matches_sql_on_odd_rows(spark, tmp_path):
    pages = [(i, u, "") for i, u in enumerate([None, "", "no", "a://b", "a://b/c/d/e/f/g", "a://b/1/2", "a://b/1/2", *(f"https://s.example.com/en/{k}" for k in range(30)), *(f"https://s.example.com/{w}/{k}" for w in "abcdefghijk" for k in range(3)), *(f"https://deep.example/en/2024/05/{w}/{k}/{x}" for w in ("offers", "news") for k in ("a", "b", "c") for x in range(6))])]
    frame(spark, pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    frame(spark, [(k, 1, k % 3 == 0 and 1 or 0) for k in range(0, 60, 2)] + [(k, int(k > 91), 0) for k in range(74, 110)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict", "template"]
    got = sorted(map(repr, map(tuple, queries.op4_url_templates(spark, str(tmp_path)).select(names).collect())))
    assert got == sorted(map(repr, con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op4_url_templates']})").fetchall()))


# Token counts


def test_suffix_sums_answer_every_limit(spark):
    rng = random.Random(3)
    rows = [(None,), ("",), ("a",)] + [("ab cé " * rng.randrange(60),) for _ in range(50)]
    encode = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts._ranks(token_counts.TOKENIZER), special_tokens={}).encode_ordinary
    n = np.array([len(encode(t or "")) for (t,) in rows])
    hist = token_counts.histogram(token_counts.with_length(spark, frame(spark, rows, "text string")))
    answers = token_counts.answers(hist, block=16)
    for r in answers.collect():
        assert (r.docs_from, r.tokens_from, r.docs_to, r.tokens_to) == ((n >= r.length).sum(), n[n >= r.length].sum(), (n <= r.length).sum(), n[n <= r.length].sum())
        assert (r.truncated_total, r.n_docs) == (np.minimum(n, r.length).sum(), (n == r.length).sum()) and abs(r.quantile - (n <= r.length).mean()) < 1e-12
    limits = [(0,), (7,), (50,), (100_000,), (None,), (-3,), (7,)]
    for block in (4, 4096):
        got = token_counts.truncated(answers, frame(spark, limits, "context long"), block=block).collect()
        assert len(got) == len(limits)
        for r in got:
            x = max(r.context or 0, 0)
            fit = (n <= x).sum() if r.context is not None and r.context >= 0 else 0
            assert (r.truncated_total, r.docs_fit) == (np.minimum(n, x).sum(), fit)
    nothing = token_counts.answers(token_counts.histogram(frame(spark, [], "n_tokens long")))
    assert [(r.docs_fit, r.truncated_total) for r in token_counts.truncated(nothing, frame(spark, [(5,)], "context long")).collect()] == [(0, 0)]
    assert token_counts.answers(token_counts.histogram(frame(spark, [], "n_tokens long"))).collect() == []


# Classifiers


def test_toxicity_learns_words_and_scores_anything(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["red", "green", "blue", "some", "more"]) for _ in range(20)) + (" you dolt" if i % 4 == 0 else "")) for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(150)] + [(1, None), (None, 1), (0, 0), (999, 1)]
    d = frame(spark, docs + [(200, None), (201, ""), (202, "x"), (202, "x")], "doc_id long, text string")
    model = toxicity.fit(spark, d, frame(spark, labels, "doc_id long, toxic int"))
    out = toxicity.score(spark, d.withColumn("score", F.lit(9)), model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in out if r.doc_id < 200) and all(0 <= r.score < 0.5 for r in out if r.doc_id >= 200) and len(out) == 204


def test_toxicity_ratios_and_scores_against_plain_sums(spark):
    rng = random.Random(12)
    docs = [(i, "".join(rng.choice("abcd ") for _ in range(40)) + "zzz" * (i % 3 == 0)) for i in range(120)]
    labels = {i: int(i % 3 == 0) for i in range(120)}
    d = frame(spark, docs, "doc_id long, text string")
    model = toxicity.fit(spark, d, frame(spark, list(labels.items()), "doc_id long, toxic int"))
    sets = {i: {t[k : k + n] for n in toxicity.LENGTHS for k in range(len(t) - n + 1)} for i, t in docs}
    bucket = {g: int(next(toxicity.text_grams([g], (len(g),)))[0]) for x in sets.values() for g in x}
    count = [Counter(b for i, x in sets.items() if labels[i] == y for b in {bucket[g] for g in x}) for y in (0, 1)]
    every = sorted(count[0] | count[1])
    total = [sum(c[b] + 1 for b in every) for c in count]
    ratio = {b: math.log((count[1][b] + 1) / total[1]) - math.log((count[0][b] + 1) / total[0]) for b in every}
    kept = {b for b in every if abs(ratio[b]) >= 3 * math.sqrt(1 / (count[0][b] + 1) + 1 / (count[1][b] + 1))}
    assert kept == set(np.flatnonzero(model.slot < len(model.value) - 1).tolist()) and bucket["zzz"] in kept
    # A score is the logistic of the sum of the features' values; weights have the ratio's sign where it is clear.
    for r in toxicity.score(spark, d, model).collect():
        margin = model.intercept + sum(model.value[model.slot[b]] for b in {bucket[g] for g in sets[r.doc_id]} & kept)
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-9
    assert model.value[model.slot[bucket["zzz"]]] > 0


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_toxicity_with_one_kind_of_label(spark, labels):
    d = frame(spark, [(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(spark, d, frame(spark, labels, "doc_id long, toxic int"))
    assert len({r.score for r in toxicity.score(spark, d, model).collect()}) == 1
    assert toxicity.score(spark, frame(spark, [], "doc_id long, text string"), model).collect() == []


def test_language_id_on_clear_and_odd_texts(spark):
    rng = random.Random(6)
    own = {"aa": ["thing", "ation", "heres", "ough", "with"], "bb": ["chung", "keit", "schaft", "über", "lich"], "cc": ["ción", "mente", "ado", "los", "que"]}
    make = lambda k, n: " ".join("".join(rng.choice(own[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    train = frame(spark, [(make(k, 60), k) for k in own for _ in range(30)] + [(None, "aa"), ("x", None)], "text string, lang string")
    model = language_id.fit(train)
    test = [(k, make(k, 12)) for k in own for _ in range(20)]
    odd = [(None, None), (None, ""), (None, "123 !!"), (None, "x" * 50_000), (None, "x" * 50_000)]
    out = language_id.identify(frame(spark, test + odd, "lang string, text string").withColumn("score", F.lit("was")), model).collect()
    judged = [r for r in out if r.lang]
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.95 * len(judged) and all(0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == "und" and r.rejected and r.score == 0 for r in out) == 3
    few = language_id.fit(frame(spark, [(make("aa", 60), "aa"), (make("bb", 60), "bb"), (make("bb", 60), "bb")], "text string, lang string"))
    assert language_id.identify(frame(spark, [(make("bb", 40),)], "text string"), few).first().lang_pred == "bb"
    none = language_id.fit(frame(spark, [], "text string, lang string"))
    assert [r.lang_pred for r in language_id.identify(frame(spark, [("a",)], "text string"), none).collect()] == ["und"]


def test_language_id_against_a_plain_compressor(spark):
    rng = random.Random(13)
    words = {"aa": ["then", "with", "heres"], "bb": ["keit", "lich", "schon"], "cc": ["cion", "ado", "que"]}
    make = lambda k, n: " ".join("".join(rng.choice(words[k]) for _ in range(2)) for _ in range(n))
    model = language_id.fit(frame(spark, [(make(k, 40), k) for k in words for _ in range(6)], "text string, lang string"))
    texts = [make(rng.choice("abc") * 2, rng.randint(1, 900)) + rng.choice(["", " 12 É!", "?"]) for _ in range(30)]
    for r in language_id.identify(frame(spark, [(t,) for t in texts], "text string"), model).collect():
        plain = " ".join("".join(c if c.isalpha() else " " for c in r.text.lower()).split())
        size = {}
        for name, content in zip(model.names, model.contents):
            total = 0
            for k in range(0, len(plain), model.chunk):
                packer = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
                total += len(packer.compress(plain[k : k + model.chunk].encode()))
            size[name] = total
        best, second = sorted(size.values())[:2]
        assert abs(size[r.lang_pred] - best) <= 2 * (1 + len(plain) // model.chunk) and abs(r.margin - (second - best)) <= 4 * (1 + len(plain) // model.chunk)


# Revisits


def test_revisits_resolve_as_of_and_check_validators(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, "http://www.A.com/x/?utm_source=q#f", 100, 200, h(ETag='"1"', Content_Type="t", Date="d1"), "one"), (2, "https://a.com/x", 300_000, 200, h(etag='"2"'), "two"),
        (3, "https://a.com:443/x", 100, 304, h(ETAG='W/"1"', Content_Length="0", Date="d3"), None), (4, "http://a.com/x", 299_999, 304, h(etag='"9"'), None), (5, "http://a.com/x", 900_000, 304, None, None),
        (6, "http://b.com/", 5, 304, h(etag='"1"'), None), (7, None, 5, 304, None, None), (8, "http://a.com/x", None, 304, None, None), (0, "http://a.com/x", 100, 304, None, None),
        (9, "http://c.com/?b=2&a=1", 1, 200, h(Last_Modified="m"), "c"), (10, "http://c.com/?a=1&b=2", 2, 304, h(last_modified="m"), None), (11, "http://c.com?a=1&b=2", 3, 304, h(last_modified="n"), None),
    ]
    schema = "record_id long, url string, s long, status int, headers map<string,string>, payload string"
    records = frame(spark, rows, schema).withColumn("captured_at", F.timestamp_seconds("s")).drop("s").withColumn("outcome", F.lit("clash"))
    out = {r.record_id: r for r in warc.resolve_revisits(records).collect()}
    assert {k: (r.response_id, r.outcome, r.payload) for k, r in out.items()} == {
        3: (1, "resolved", "one"), 4: (1, "mismatch", None), 5: (2, "unverified", "two"), 6: (None, "missing", None), 7: (None, "missing", None), 8: (None, "missing", None),
        0: (None, "missing", None), 10: (9, "resolved", "c"), 11: (9, "mismatch", None),
    }
    assert out[3].headers == {"etag": 'W/"1"', "content-type": "t", "date": "d3"}
    assert warc.resolve_revisits(records.filter("false")).collect() == []


def test_many_captures_of_one_url(spark):
    rng = random.Random(8)
    rows = [(i, "http://h/p", rng.randrange(2_000_000), rng.choice([200, 304, 304]), None, str(i)) for i in range(400)]
    records = frame(spark, rows, "record_id long, url string, s long, status int, headers map<string,string>, payload string").withColumn("captured_at", F.timestamp_seconds("s"))
    got = {r.record_id: r.response_id for r in warc.resolve_revisits(records).collect()}
    full = sorted((r[2], r[0]) for r in rows if r[3] == 200)
    want = {r[0]: max((f for f in full if f < (r[2], r[0])), default=(None, None))[1] for r in rows if r[3] == 304}
    assert got == want


def test_repeated_records_do_not_multiply(spark):
    schema = "record_id long, url string, s long, status int, headers map<string,string>, payload string"
    rows = [(1, "http://h/p", 1, 200, None, "a"), (1, "http://h/p", 1, 200, None, "a"), (1, "http://h/p", 1, 200, {"etag": "x"}, "b"), (2, "http://h/p", 9000, 304, None, None)]
    rows += [(2, "http://h/p", 9000, 304, None, None), (2, "http://h/q", 9000, 304, None, None), (None, "http://h/p", 9000, 304, None, None), (None, "http://h/p", 2, 200, None, "n")]
    records = frame(spark, rows, schema).withColumn("captured_at", F.timestamp_seconds("s"))
    out = warc.resolve_revisits(records).collect()
    assert sorted((r.record_id or 0, r.canonical_url, r.response_id, r.outcome) for r in out if r.response_id) == [(2, "h/p", 1, "unverified")] * 2
    assert sorted((r.record_id or 0, r.outcome) for r in out if not r.response_id) == [(0, "missing"), (2, "missing")]
    payloads = {r.payload for r in out if r.response_id}
    assert len(payloads) == 1 and payloads < {"a", "b"}
    assert {r.payload for r in warc.resolve_revisits(records.repartition(3)).collect() if r.response_id} == payloads


# Mixing


def fill(sizes, weights, times=3):
    """Targets by passing the excess on until none is above."""
    total, done = sum(sizes.values()), {}
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    w = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    while True:
        rest = [k for k in order if k not in done]
        share = {k: (total - sum(done.values())) * w[k] / sum(w[x] for x in rest) for k in rest}
        over = [k for k in rest if share[k] > times * sizes[k]]
        if not over:
            return {**done, **share}
        done |= {k: times * sizes[k] for k in over}


def test_mix_meets_targets_whole_documents_and_repeats(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"]), rng.choice([None, "", "x y", "w " * rng.randrange(40)]), 1) for i in range(300)] + [(5, "tiny", "one two", 1), (5, "tiny", "one two", 1)]
    docs = frame(spark, rows, "doc_id long, source string, text string, size int")
    out = mixing.mix(spark, docs, block_rows=7).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 3 * r.size
    want, largest = fill(sizes, (5, 2, 1)), max(r.size for r in out)
    assert len(out) == len(rows) and sum(taken.values()) == sum(sizes.values())
    assert all(abs(want[k] - target[k]) < 1e-6 and abs(taken[k] - want[k]) <= largest for k in want)
    assert sorted(map(repr, mixing.mix(spark, docs.repartition(3), block_rows=1000).collect())) == sorted(map(repr, out))


def test_mix_goes_by_virtual_finish_time(spark):
    # Against a plain queue: copies in order of finish, cut at the budget.
    rng = random.Random(10)
    rows = [(rng.choice([None, rng.randrange(30)]), rng.choice(["a", "b", "c", "hot", "hot"]), "w " * rng.randrange(60) + str(i)) for i in range(200)]
    rows += [(7, "a", "long " * 3000)] + [(None, "hot", "same row")] * 40
    out = mixing.mix(spark, frame(spark, rows, "doc_id long, source string, text string"), block_rows=11).collect()
    goal = {r.source: r.target for r in out}
    copies = []
    for source in goal:
        own = sorted((r for r in out if r.source == source and r.size), key=lambda r: r.virtual_finish)
        at = 0
        for turn in range(3):
            for k, r in enumerate(own):
                at += r.size
                copies.append((at / goal[source], source, turn, k, r.size))
        assert all(a.virtual_finish < b.virtual_finish for a, b in zip(own, own[1:]))
    left, want = sum(r.size for r in out), defaultdict(int)
    for _, source, _, k, part in sorted(copies):
        want[source, k] += min(part, left)
        left -= min(part, left)
    got = {}
    for source in goal:
        for k, r in enumerate(sorted((r for r in out if r.source == source and r.size), key=lambda r: r.virtual_finish)):
            got[source, k] = r.taken
    assert got == {k: want[k] for k in got}


def test_the_cut_decides_what_is_taken(spark):
    """Three sources of equal weight: words one by one, two documents of 30, one of 90. The budget ends inside the last."""
    rows = [(k, "a", "w") for k in range(60)] + [(100, "b", "w " * 30), (101, "b", "w " * 30)] + [(200, "c", "w " * 90)]
    out = mixing.mix(spark, frame(spark, rows, "doc_id long, source string, text string"), weights=(1, 1, 1)).collect()
    by = defaultdict(int)
    for r in out:
        by[r.source] += r.taken
    # Each target is 70. b's third copy finishes at 90 / 70, c's first too; a's words finish in between, one by one.
    assert {r.target for r in out} == {70.0} and by["a"] == 90 and by["b"] == 90 and by["c"] == 30
    assert sum(by.values()) == 210


def test_mix_of_nothing(spark):
    assert mixing.mix(spark, frame(spark, [], "doc_id long, source string, text string")).collect() == []
    empty = mixing.mix(spark, frame(spark, [(1, "a", None), (None, None, "")], "doc_id long, source string, text string")).collect()
    assert [(r.size, r.taken) for r in empty] == [(0, 0)] * 2
