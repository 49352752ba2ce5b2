"""Rule tables on reports: gate, routing, kinds, rejects, and how well the gate does."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import text
from tideline.operators.ordered import numbered
from tideline.operators.rules import Rule, evaluate, first_match, labels, score, verdict, word_rules
from tideline.session import REPORTS, reports, table

#: Tables of this engine's own, for the synthetic reports; a deployment brings its own patterns.
GATE = [
    Rule("insult", r"idiot|moron|worthless|pathetic", 40), Rule("noise", r"[#$%&*]{3}", -30), Rule("shout", r"!!", -20),
    Rule("prose", r"(^| )(the|der|le|la|de|el) ", 30), Rule("long", r"[a-z]{12}", 10), Rule("figure", r"[0-9]{3}", 15),
]
KINDS = [Rule("secret", r"token|password|secret"), Rule("figure", r"[0-9]{2}"), Rule("shout", r"!!"), Rule("table", r" \| "), Rule("markup", r"[#$%&*]{3}")]
REJECTS = [Rule("empty", r"^.{0,7}$"), Rule("list", r" \| .* \| "), Rule("shouting", r"!!.*!!.*!!")]
DESKS = [Rule("figures", r"[0-9]"), Rule("noise", r"[#$%&*]{3}"), Rule("loud", r"!!")]


def _matches(rules, c):
    return [(r, f"regexp_matches({c}, '{r.pattern}')") for r in rules]


def _score_sql(rules, c):
    return "greatest(0, least(100, " + " + ".join(f"CASE WHEN {m} THEN {r.weight} ELSE 0 END" for r, m in _matches(rules, c)) + "))"


def _first_sql(rules, c, default="NULL"):
    return "CASE " + " ".join(f"WHEN {m} THEN '{r.name}'" for r, m in _matches(rules, c)) + f" ELSE {default} END"


_LEVEL = "CASE WHEN source IN ('src0', 'src1') THEN 30 ELSE 40 END"
_GATE = f"""WITH {REPORTS}, scored AS (SELECT fp, doc_id, source, {_score_sql(GATE, 'lower(text)')} AS score FROM reports),
gated AS (SELECT *, CASE WHEN score >= {_LEVEL} THEN 'feed' WHEN score >= {_LEVEL} - 20 THEN 'tray' ELSE 'exclude' END AS verdict FROM scored)"""


def gated(spark, sf_dir):
    r = reports(spark, sf_dir).withColumn("score", score(F.lower("text"), GATE))
    level = F.when(F.col("source").isin("src0", "src1"), 30).otherwise(40)
    return r.withColumn("verdict", verdict(F.col("score"), level, level - 20))


@query(59, 62, 64, 66, 70, 71, 72, 77, 79, 80, 279, 280, sql=f"{_GATE} SELECT fp, CAST(score AS INTEGER) AS score, verdict FROM gated")
def gate(spark, sf_dir):
    return gated(spark, sf_dir).select("fp", "score", "verdict")


@query(253, sql=f"""{_GATE}, t AS (SELECT toxic = 1 AS truth, verdict = 'feed' AS said FROM gated JOIN labels USING (doc_id))
SELECT count(*) AS n, round(count(*) FILTER (truth AND said) / CAST(nullif(count(*) FILTER (truth), 0) AS DOUBLE), 6) AS recall,
  round(count(*) FILTER (truth AND said) / CAST(nullif(count(*) FILTER (said), 0) AS DOUBLE), 6) AS "precision",
  round(count(*) FILTER (NOT truth AND NOT said) / CAST(nullif(count(*) FILTER (NOT truth), 0) AS DOUBLE), 6) AS specificity,
  round(count(*) FILTER (truth = said) / CAST(count(*) AS DOUBLE), 6) AS exact FROM t""")
def gate_report(spark, sf_dir):
    judged = gated(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate(judged.select((F.col("toxic") == 1).alias("truth"), (F.col("verdict") == "feed").alias("said")), "truth", "said")


@query(68, 83, 84, 85, 87, 88, 89, 90, 268, sql=f"WITH {REPORTS} SELECT fp, {_first_sql(KINDS, 'lower(text)', chr(39) + 'other' + chr(39))} AS kind, {_first_sql(REJECTS, 'summary')} AS reject FROM reports")
def kinds(spark, sf_dir):
    return reports(spark, sf_dir).select("fp", first_match(F.lower("text"), KINDS, "other").alias("kind"), first_match(F.col("summary"), REJECTS).alias("reject"))


@query(73, 74, 75, 76, sql=f"""
WITH {REPORTS}, d AS (SELECT fp, list_filter([{', '.join(f"CASE WHEN {m} THEN '{r.name}' END" for r, m in _matches(DESKS, 'text'))}], lambda x: x IS NOT NULL) AS f FROM reports)
SELECT fp, unnest(CASE WHEN len(f) > 0 THEN f ELSE ['main'] END) AS desk FROM d""")
def routing(spark, sf_dir):
    return reports(spark, sf_dir).select("fp", F.explode(labels(F.col("text"), DESKS, "main")).alias("desk"))


@query(78, sql=f"""{_GATE}, r AS (SELECT fp, source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM gated WHERE verdict <> 'feed')
SELECT fp, source FROM r WHERE k <= 3""")
def turned_away(spark, sf_dir):
    """The newest three of each source that the gate turned away: an audit sample (the limit is the feature)."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    return gated(spark, sf_dir).filter("verdict <> 'feed'").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("fp", "source")


@query(65, 385, sql=f"""WITH {REPORTS} SELECT fp, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 25) AS BIGINT) AS batch FROM reports""")
def reading_batches(spark, sf_dir):
    """Batches of 25 a source, as a model would be asked."""
    r = numbered(reports(spark, sf_dir).select("fp", "source", "doc_id"), ["source"], "doc_id", ["fp"], "n", width=5_000)
    return r.select("fp", F.floor((F.col("n") - 1) / 25).alias("batch"))


_KIND_OF = "['report', 'claim', 'aside', 'alert', 'tally'][length(word) % 5 + 1]"


@query(59, 73, 83, 84, sql=rf"""WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')) AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word FROM d), r AS (SELECT word, count(*) AS n FROM x GROUP BY word HAVING count(*) BETWEEN 2 AND 60),
rules AS (SELECT word, CASE WHEN n % 3 = 0 THEN -n ELSE n END AS weight, {_KIND_OF} AS kind, CASE WHEN n % 4 <> 1 THEN 'desk' || (length(word) % 4) END AS label, n AS priority FROM r),
h AS (SELECT doc_id, CAST(sum(weight) AS BIGINT) AS points, min(struct_pack(p := priority, w := word, k := kind)).k AS kind, list_sort(list_distinct(list(label))) AS labels, count(*) AS n_rules FROM x JOIN rules USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(points, 0) AS points, kind, array_to_string(coalesce(labels, []), ',') AS labels, coalesce(n_rules, 0) AS n_rules FROM d LEFT JOIN h USING (doc_id)""")
def ruled_by_words(spark, sf_dir):
    """Points, kind and labels by a table of thousands of word rules, read off the corpus: every word that 2 to 60 documents
    have is a rule, its weight, kind, label and priority follow from the word and its count."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    r = d.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n between 2 and 60")
    kinds = F.array(*(F.lit(k) for k in ("report", "claim", "aside", "alert", "tally")))
    rules_ = r.select(
        "word", F.when(F.col("n") % 3 == 0, -F.col("n")).otherwise(F.col("n")).alias("weight"), F.element_at(kinds, (F.length("word") % 5 + 1).cast("int")).alias("kind"),
        F.when(F.col("n") % 4 != 1, F.concat(F.lit("desk"), F.length("word") % 4)).alias("label"), F.col("n").alias("priority"),
    )
    return word_rules(d, "doc_id", F.col("w"), rules_).withColumn("labels", F.array_join("labels", ","))
