"""Queries that rewrite texts: by a dictionary learned from the corpus, and by letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.lineage import cut
from tideline.operators.rewriting import SOUNDS, respell_runs, rewrite, sound_key
from tideline.session import table

_WORDS = r"[A-Za-zÀ-ÿ]{4,}"


def preferred_spellings(documents, col: str = "text", least: int = 5):
    """(pattern, replacement): of words that sound alike and begin with the same letter, the rarer become the most common one,
    which is `least` times as common at least; pairs of words and their doubled form, two in a row, become one."""
    words = documents.select(F.explode(F.regexp_extract_all(col, F.lit(f"({_WORDS})"), F.lit(1))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = cut(words)  # read three times
    keyed = words.select("w", "n", sound_key(F.col("w")).alias("k"), F.left("w", F.lit(1)).alias("f")).filter("k <> ''")
    best = keyed.groupBy("k", "f").agg(F.max(F.struct("n", "w")).alias("b"))
    swaps = keyed.join(best, ["k", "f"]).filter(F.col("b.n") >= F.col("n") * least).select(F.col("w").alias("pattern"), F.col("b.w").alias("replacement"))
    doubled = words.filter(F.col("n") >= 20).select(F.concat_ws(" ", "w", "w").alias("pattern"), F.col("w").alias("replacement"))
    return swaps.unionByName(doubled)


@query(136, 137)
def respelled_texts(spark, sf_dir):
    """Documents with the corpus' own preferred spellings, as digests of the new texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    if d.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        d = d.repartition(spark.sparkContext.defaultParallelism)  # a small file of few row groups is one task otherwise
    out = rewrite(d, "text", preferred_spellings(d))
    return out.select("doc_id", "n_rewritten", F.length("text").alias("chars"), F.md5("text").alias("digest"))


#: Letters beyond A-Z as they are spelt out, and words for kinds of places (fixed values).
LETTERS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("é", "e"), ("è", "e"), ("ê", "e"), ("ç", "s"), ("ñ", "ny"), ("í", "i"), ("ó", "o"), ("á", "a"), ("ú", "u")]
KINDS = {"éla": "city", "èle": "port", "äer": "bridge", "über": "pass", "ñde": "valley"}
_RUN = r"[A-Za-z]*[À-ÿ][A-Za-zÀ-ÿ]*(?: [A-Za-z]*[À-ÿ][A-Za-zÀ-ÿ]*)*"
#: The same runs for Java's regular expressions, which read a long run by recursion unless it never steps back.
_STRAIGHT = r"(?<![A-Za-zÀ-ÿ])[A-Za-z]*+[À-ÿ][A-Za-zÀ-ÿ]*+(?: [A-Za-z]*+[À-ÿ][A-Za-zÀ-ÿ]*+)*+"


def _spelt_sql(word: str) -> str:
    for letter, latin in LETTERS:
        word = f"replace({word}, '{letter}', '{latin}')"
    return word


_KIND = "CASE WHEN len({0}) > 1 THEN CASE lower({0}[1]) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END END"
_SAID = f"array_to_string(list_transform({{0}}, lambda w: upper(left({_spelt_sql('w')}, 1)) || substr({_spelt_sql('w')}, 2)), ' ')"
_SOUND = "translate(lower(w), '" + "".join(SOUNDS) + "', '" + "".join(SOUNDS.values()) + "')"


@query(306, 307, 308, sql=rf"""WITH pieces AS (
  SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '({_RUN})', chr(1) || '\1' || chr(2), 'g'), chr(2))) AS p,
    unnest(range(len(regexp_split_to_array(regexp_replace(text, '({_RUN})', chr(1) || '\1' || chr(2), 'g'), chr(2))))) AS i FROM documents WHERE text IS NOT NULL
), parted AS (
  SELECT doc_id, i, p, contains(p, chr(1)) AS is_run, split_part(p, chr(1), 1) AS before, string_split(split_part(p, chr(1), 2), ' ') AS w FROM pieces
), kinds AS (
  SELECT *, {_KIND.format("w")} AS kind FROM parted
), spelt AS (
  SELECT doc_id, i, CASE WHEN NOT is_run THEN p WHEN kind IS NULL THEN before || {_SAID.format("w")} ELSE before || {_SAID.format("w[2:]")} || ' ' || kind END AS s FROM kinds
), texts AS (
  SELECT doc_id, string_agg(s, '' ORDER BY i) AS t FROM spelt GROUP BY doc_id
), keyed AS (
  SELECT doc_id, string_split(regexp_replace({_SOUND}, '[^A-Z]', '', 'g'), '') AS k FROM (SELECT doc_id, split_part(text, ' ', 1) AS w FROM documents)
)
SELECT d.doc_id, length(t) AS chars, md5(t) AS digest, array_to_string(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN i = 1 OR k[i] <> k[i - 1] THEN k[i] ELSE '' END), '') AS sound
FROM documents d LEFT JOIN texts USING (doc_id) LEFT JOIN keyed USING (doc_id)""")
def anglicised(spark, sf_dir):
    """Documents whose words in other letters are spelt in A-Z, and the sound of their first word."""
    d = table(spark, sf_dir, "documents")
    new = respell_runs(F.col("text"), _STRAIGHT, KINDS, LETTERS)
    return d.select("doc_id", new.alias("t"), sound_key(F.split_part("text", F.lit(" "), F.lit(1))).alias("sound")).select("doc_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"), "sound")
