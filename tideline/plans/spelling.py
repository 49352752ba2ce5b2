"""Search words that a lexicon puts right: edits, sound, groups of alternatives, strong terms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import text
from tideline.operators import search
from tideline.session import table

_LEX = r"""lex AS (SELECT word, count(DISTINCT p_partkey) AS df FROM (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^\p{L}\p{Nd}]+'), lambda x: length(x) >= 4)) AS word FROM part) GROUP BY word),
typed AS (SELECT c_custkey, c_mktsegment, word, substr(word, 1, k) || substr(word, k + 2) AS slip FROM (SELECT c_custkey, c_mktsegment, word, CAST(c_custkey % length(word) AS INTEGER) AS k
  FROM customer JOIN (SELECT word, row_number() OVER (ORDER BY word) - 1 AS n FROM lex) l ON l.n = c_custkey % (SELECT count(*) FROM lex)))"""


def lexicon(spark, sf_dir):
    words = F.filter(text.words(F.concat_ws(" ", "p_name", "p_type", "p_brand")), lambda x: F.length(x) >= 4)
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(words)).alias("word"))
    return p.groupBy("word").agg(F.count("*").alias("df"))


def typed(spark, sf_dir):
    """A word of the lexicon for each customer, with one letter left out. The lexicon is that of part names, a few words."""
    lex = lexicon(spark, sf_dir)
    numbered = lex.select("word", (F.row_number().over(Window.orderBy("word")) - 1).alias("n"), F.count("*").over(Window.partitionBy()).alias("m"))
    size = numbered.select(F.max("m").alias("m"))  # one row
    c = table(spark, sf_dir, "customer").select("c_custkey").crossJoin(F.broadcast(size)).withColumn("n", F.col("c_custkey") % F.col("m"))
    k = F.col("c_custkey") % F.length("word")
    return c.join(numbered.select("word", "n"), "n").select("c_custkey", "word", F.concat(F.substr("word", F.lit(1), k.cast("int")), F.substr("word", (k + 2).cast("int"))).alias("slip"))


@query(300, 302, sql=f"""WITH {_LEX}, w AS (SELECT DISTINCT slip FROM typed WHERE length(slip) >= 4),
c AS (SELECT slip, word, df FROM w JOIN lex ON levenshtein(slip, word) BETWEEN 1 AND CASE WHEN length(slip) >= 9 THEN 2 ELSE 1 END WHERE length(slip) >= 5 OR length(slip) >= 4 AND levenshtein(slip, word) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY slip ORDER BY df DESC, word) AS k FROM c) SELECT slip, word AS candidate, df FROM r WHERE k <= 3""")
def respellings(spark, sf_dir):
    """Slips with the three most frequent words of the lexicon (the number is the feature) that are one edit away, or two for
    slips of nine letters and more. Slips and words meet on what is left when letters are dropped."""
    slips = typed(spark, sf_dir).select(F.col("slip").alias("word")).filter(F.length("word") >= 4).distinct()
    out = search.respelled(slips, lexicon(spark, sf_dir), 3)
    return out.select(F.col("word").alias("slip"), "candidate", "df")


_SKELETON = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'ph', 'f', 'g'), '[ckg]h|q|c', 'k', 'g'), '(?:ee|ou|oo)', 'u', 'g'), '[aeiouywh]', '', 'g')"


@query(301, 303, 304, sql=rf"""WITH {_LEX}, s AS (SELECT word, df, {_SKELETON.format('word')} AS k0 FROM lex),
k AS (SELECT word, df, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(k0, 'bb', 'b', 'g'), 'll', 'l', 'g'), 'nn', 'n', 'g'), 'ss', 's', 'g'), 'tt', 't', 'g') AS key FROM s),
t AS (SELECT DISTINCT c_custkey, word, slip FROM typed), g AS (SELECT c_custkey, slip, {_SKELETON.format('slip')} AS k0 FROM t),
q AS (SELECT c_custkey, slip, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(k0, 'bb', 'b', 'g'), 'll', 'l', 'g'), 'nn', 'n', 'g'), 'ss', 's', 'g'), 'tt', 't', 'g') AS key FROM g),
o AS (SELECT q.c_custkey, q.slip, k.word, k.df FROM q LEFT JOIN k ON k.key = q.key)
SELECT c_custkey, slip, coalesce(string_agg(word, '|' ORDER BY word), '') AS alternatives, coalesce(max(df) <= 500, false) AS strong FROM o GROUP BY c_custkey, slip""")
def understood(spark, sf_dir):
    """Each typed word as a group of alternatives that sound like it, strong if none of them is a common word."""
    lex = lexicon(spark, sf_dir).withColumn("key", text.sound(F.col("word")))
    groups = lex.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("word")), "|").alias("alternatives"), F.max("df").alias("most"))
    asked = typed(spark, sf_dir).select("c_custkey", "slip").distinct().withColumn("key", text.sound(F.col("slip")))
    return asked.join(groups, "key", "left").select("c_custkey", "slip", F.coalesce("alternatives", F.lit("")).alias("alternatives"), F.coalesce(F.col("most") <= 500, F.lit(False)).alias("strong"))
