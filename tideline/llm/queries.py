"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import imatch, language_id, periodic_runs, quality_rules, token_alignment, token_counts, toxicity, url_templates, warc
from tideline.llm.decontaminate import decontaminate
from tideline.llm.line_dedup import dedup_lines
from tideline.llm.mixing import mix
from tideline.llm.ngram_join import ngram_jaccard_join

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out():
    """Rows that nothing is learned from; without an id they are held out, too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the shingle sets of all documents, the group each is in, and how many it is linked with."""
    found = ngram_jaccard_join(spark, table(spark, sf_dir, "documents"), n=5, percent=80)
    return found.documents.select(F.col("id").alias("doc_id"), F.col("n_tokens").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.component_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

#: (host, path, verdict)
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, fitting rule and verdict, and the template that its path falls under."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good"))
    return url_templates.judge(spark, pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suffix sums over the exact histogram of encoded lengths answer, for every length that occurs."""
    lengths = token_counts.with_length(spark, table(spark, sf_dir, "documents").select("text"))
    return token_counts.answers(token_counts.histogram(lengths))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold windows of benchmark items, of which, and over how many words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(spark, docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS p
  FROM items WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT k FROM phrases
), runs AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS p
  FROM words, lengths WHERE len(w) >= k
), found AS (
  SELECT r.doc_id, r.pos, r.k, q.item_id FROM runs r JOIN phrases q ON q.k = r.k AND q.p = r.p
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit h ON h.doc_id = w.doc_id LEFT JOIN named n ON n.doc_id = w.doc_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a classifier learned outside the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learn = language_id.training_rows
    model = toxicity.fit(spark, learn(docs), learn(labels))
    judged = toxicity.score(spark, docs, model)
    return judged.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by compressors fitted outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.training_rows(docs))
    judged = language_id.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document, and a digest of what is left."""
    out = dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of pages: of each a full response and page_id mod 4 revisits, days later, under other spellings of
    the URL, some with another entity tag, with the date only or without validators."""
    k = F.col("k")
    spelled = F.when(k % 3 == 1, F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/?utm_source=feed"))).when(k % 3 == 2, F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("#again"))).otherwise(F.col("url"))
    tag = F.concat(F.lit('"'), F.md5(F.when(F.col("page_id") * 7 % 11 + k == 5, F.lit("other")).otherwise(F.col("html"))), F.lit('"'))
    day = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 97 * 3600), "yyyy-MM-dd HH:mm")
    first = F.array(
        F.struct(F.lit("ETag").alias("key"), F.when(F.col("page_id") % 5 != 3, F.when(k % 2 == 1, F.concat(F.lit("W/"), tag)).otherwise(tag)).alias("value")),
        F.struct(F.lit("Last-Modified").alias("key"), F.when(F.col("page_id") % 3 != 1, day).alias("value")),
        F.struct(F.lit("Content-Type").alias("key"), F.when(k == 0, "text/html").otherwise("text/plain").alias("value")),
        F.struct(F.lit("Cache-Control").alias("key"), F.concat(F.lit("max-age="), (k * 60).cast("string")).alias("value")),
    )
    return pages.select("page_id", "url", "html", F.explode(F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int"))).alias("k")).select(
        (F.col("page_id") * 4 + k).alias("record_id"), spelled.alias("url"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 7919 % 86400 + k * 86400 * 2).alias("captured_at"),
        F.when(k == 0, 200).otherwise(304).alias("status"), F.map_from_entries(F.filter(first, lambda x: x["value"].isNotNull())).alias("headers"),
        F.when(k == 0, F.col("html")).alias("payload"),
    )


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits among the archive records of pages, with the response that each stands for."""
    found = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "canonical_url", "response_id", "outcome", F.array_join(lines, "; ").alias("headers"), F.md5("payload").alias("payload_md5"))


OP9_SQL = r"""
WITH records AS (
  SELECT p.page_id * 4 + k AS record_id, CASE WHEN k % 3 = 1 THEN regexp_replace(url, '[?#].*$', '') || '/?utm_source=feed'
      WHEN k % 3 = 2 THEN regexp_replace(url, '[?#].*$', '') || '#again' ELSE url END AS url,
    1704067200 + page_id * 7919 % 86400 + k * 86400 * 2 AS at_s, k = 0 AS is_full,
    CASE WHEN page_id % 5 <> 3 THEN '"' || md5(CASE WHEN page_id * 7 % 11 + k = 5 THEN 'other' ELSE html END) || '"' END AS tag, k % 2 = 1 AS weak,
    CASE WHEN page_id % 3 <> 1 THEN strftime(to_timestamp(1704067200 + page_id % 97 * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') END AS modified, html, k
  FROM pages p, (SELECT unnest(range(0, 4)) AS k) WHERE k <= page_id % 4
), bare AS (
  SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM records
), named AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www[0-9]*\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&') AS args FROM bare
), urls AS (
  SELECT *, base || CASE WHEN args <> '' THEN '?' || args ELSE '' END AS canonical_url FROM named
), placed AS (
  SELECT *, last_value(CASE WHEN is_full THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY at_s, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS response_id FROM urls
), judged AS (
  SELECT r.record_id, r.canonical_url, r.response_id, r.k, r.tag, r.weak, r.modified, f.tag AS old_tag, f.modified AS old_modified, f.html,
    CASE WHEN f.record_id IS NULL THEN 'missing' WHEN r.tag IS NOT NULL AND f.tag IS NOT NULL THEN CASE WHEN r.tag = f.tag THEN 'resolved' ELSE 'mismatch' END
      WHEN r.modified IS NOT NULL AND f.modified IS NOT NULL THEN CASE WHEN r.modified = f.modified THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS outcome
  FROM placed r LEFT JOIN urls f ON f.record_id = r.response_id WHERE NOT r.is_full
)
SELECT record_id, canonical_url, response_id, outcome, concat_ws('; ', 'cache-control: max-age=' || CAST(k * 60 AS VARCHAR),
    CASE WHEN outcome IN ('resolved', 'unverified') THEN 'content-type: text/html' ELSE 'content-type: text/plain' END,
    'etag: ' || coalesce(CASE WHEN weak THEN 'W/' ELSE '' END || tag, CASE WHEN outcome IN ('resolved', 'unverified') THEN old_tag END),
    'last-modified: ' || coalesce(modified, CASE WHEN outcome IN ('resolved', 'unverified') THEN old_modified END)) AS headers,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN md5(html) END AS payload_md5
FROM judged
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(spark, docs, weights=(5, 2, 1), most_repeats=3, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), md5(text))) AS k, row_number() OVER () AS i FROM documents
), sizes AS (
  SELECT none, name, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY none, name
), weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY none, name) - 1) % 3 + 1 AS INTEGER)] AS weight, 3 * source_size AS most FROM sizes
), ordered AS (
  SELECT *, sum(source_size) OVER () AS total,
    sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
  FROM (SELECT *, CAST(most AS DOUBLE) / weight AS ratio FROM weighed)
  WINDOW before AS (ORDER BY ratio, none, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT *, most * weights <= weight * rest AS reached FROM ordered
), goals AS (
  SELECT none, name, source_size, CASE WHEN reached THEN CAST(most AS DOUBLE) ELSE weight *
    (CAST(total - coalesce(sum(CASE WHEN reached THEN most END) OVER (), 0) AS DOUBLE) / CAST(sum(CASE WHEN NOT reached THEN weight END) OVER () AS DOUBLE)) END AS target
  FROM filled
), placed AS (
  SELECT d.*, g.source_size, g.target, sum(d.size) OVER (PARTITION BY d.none, d.name ORDER BY d.k, d.size, d.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done
  FROM docs d JOIN goals g ON g.none = d.none AND g.name = d.name
), copies AS (
  SELECT *, CAST(done + copy * source_size AS DOUBLE) / target AS finish FROM placed, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0
), queue AS (
  SELECT i, least(size, (SELECT sum(size) FROM docs) - (sum(size) OVER (ORDER BY finish, none, name, k, size, i, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)) AS w FROM copies
), served AS (
  SELECT i, sum(w) AS taken FROM queue WHERE w > 0 GROUP BY i
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN served USING (i)
"""


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how alike neighbours are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.with_next(spark, docs, imatch.lexicon(spark, docs)).withColumnRenamed("id", "doc_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document, and whether the cascade of quality rules keeps it."""
    docs, always = table(spark, sf_dir, "documents").select("doc_id", "text"), quality_rules.BASE
    own = quality_rules.plan(spark, docs, always=always)
    judged = quality_rules.judge(spark, docs, own, always=always)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *always, failed.alias("base_failed"), "kept")


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM words WHERE len(w) > 3
), again AS (
  SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, list(i) AS places FROM windows GROUP BY doc_id, g HAVING count(*) > 1)
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM again) GROUP BY doc_id
), measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut, len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*([-*]|•)'))) AS n_list
  FROM words LEFT JOIN covered USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words
  OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 5 * n_lines OR 10 * n_lettered < 7 * n_words OR 10 * n_cut > 3 * n_lines OR 10 * n_list > 9 * n_lines) AS kept
FROM failed
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of two public tokenizers' tokens, and how common each document's are in the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_alignment.cross_align(spark, docs, keep=["doc_id"], digest=True)
    return found.documents.withColumnRenamed("groups", "groups_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of which get a periodic tail first."""
    docs = table(spark, sf_dir, "documents")
    edited = docs.select("doc_id", periodic_runs.with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.detect_runs(spark, edited, least_length=6, exponent=4)
    first = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    longest = F.when(F.size("runs") > 0, first)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest["start"].alias("start"), (-longest["n"]).alias("length"), longest["period"].alias("period"),
        F.floor(-1000 * longest["n"] / longest["period"]).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op1_ngram_join": op1_ngram_join, "op2_imatch": op2_imatch, "op3_line_dedup": op3_line_dedup, "op4_url_templates": op4_url_templates, "op5_token_counts": op5_token_counts, "op6_decontaminate": op6_decontaminate, "op7_toxicity": op7_toxicity, "op8_language_id": op8_language_id, "op9_revisits": op9_revisits, "op10_mixing": op10_mixing, "op11_quality_rules": op11_quality_rules, "op12_token_alignment": op12_token_alignment, "op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op4_url_templates": url_templates.sql(URL_RULES), "op1_ngram_join": OP1_SQL, "op6_decontaminate": OP6_SQL, "op9_revisits": OP9_SQL, "op10_mixing": OP10_SQL, "op11_quality_rules": OP11_SQL}
