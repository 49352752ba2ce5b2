"""Wording and what follows from it: same points, figures a text states, who told it before, keys of stories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import sets, text
from tideline.lineage import cut
from tideline.operators.pairrules import Rule, matches
from tideline.plans.pairs import _CARDS, _EVENT, _LOOSE, _TALK, block, cards, event, loose, talk
from tideline.session import REPORTS, reports, table

_POINT = "list_distinct(regexp_extract_all(regexp_replace(lower({0}.text), '\\[\\[[0-9]+\\]\\]', '', 'g'), '[a-z0-9''-]+'))"
_MARKS = "array_to_string(regexp_extract_all({0}.text, '\\[\\[[0-9]+\\]\\]'), ',')"


@query(211, sql=f"""WITH t AS (SELECT a.conv_id, b.turn, a.text AS was, b.text AS now, {_POINT.format('a')} AS wa, {_POINT.format('b')} AS wb, {_MARKS.format('a')} AS ma, {_MARKS.format('b')} AS mb
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, coalesce(now <> '' AND ma = mb AND abs(len(wa) - len(wb)) <= 3 AND len(list_intersect(wa, wb)) >= len(wa) - 3, false) AS same FROM t""")
def same_wording(spark, sf_dir):
    """Is a turn the one before it, but for a few words: its marks, as many words but three, and all of them but three.
    Null or empty texts are not the same as anything."""
    point = F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower("text"), r"\[\[[0-9]+\]\]", ""), F.lit(r"([a-z0-9'-]+)"), F.lit(1)))
    marks = F.array_join(F.regexp_extract_all("text", F.lit(r"(\[\[[0-9]+\]\])"), F.lit(1)), ",")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", point.alias("w"), marks.alias("m"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("v"), F.col("m").alias("k"))
    near = (F.abs(F.size("v") - F.size("w")) <= 3) & (sets.shared(F.col("v"), F.col("w")) >= F.size("v") - 3)
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.coalesce((F.col("text") != "") & (F.col("m") == F.col("k")) & near, F.lit(False)).alias("same"))


_BARE = "regexp_replace(regexp_replace(lower(coalesce(summary, '')), '^al[- ]', ''), '[^a-z]', '', 'g')"
_REST = "string_split(regexp_replace(substr(k, 2), '[aeiouy]', '', 'g'), '')"


@query(310, 405, sql=f"""WITH {REPORTS}, k AS (SELECT fp, summary, {_BARE} AS k FROM reports),
l AS (SELECT fp, left(k, 1) AS one, {_REST} AS r FROM k),
c AS (SELECT fp, one || array_to_string(list_transform(list_filter(list_zip(r, list_concat([''], r[:-2])), lambda x: x[1] <> x[2]), lambda x: x[1]), '') AS sound FROM l),
f AS (SELECT fp, lower(regexp_replace(translate(coalesce(summary, ''), '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩یىک', '01234567890123456789ييك'), '[ًٌٍَُِّْـ]', '', 'g')) AS folded FROM reports)
SELECT sound, count(*) AS n, min(folded) AS one FROM c JOIN f USING (fp) GROUP BY sound""")
def spellings(spark, sf_dir):
    """Headlines by their consonants, so that spellings meet, with how many there are and the first in folded letters."""
    r = reports(spark, sf_dir).select(text.consonants(F.coalesce("summary", F.lit(""))).alias("sound"), text.latin_digits(F.coalesce("summary", F.lit(""))).alias("folded"))
    return r.groupBy("sound").agg(F.count("*").alias("n"), F.min("folded").alias("one"))


def _told_sql(c: str) -> str:
    t = f"regexp_replace(lower(coalesce({c}, '')), '[ \\t\\n]+', ' ', 'g')"
    part = lambda k: f"regexp_extract_all({t}, '{text.TOLD}', {k})"
    bare = "regexp_replace(x.n, '[.,]+$', '')"
    scale = "CASE WHEN " + bare + " <> x.n THEN 1.0 WHEN x.s = ' thousand' THEN 1e3 WHEN x.s = ' million' THEN 1e6 WHEN x.s = ' billion' THEN 1e9 ELSE 1.0 END"
    value = f"CASE WHEN regexp_matches({bare}, '^([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)([.][0-9]+)?$') THEN TRY_CAST(replace({bare}, ',', '') AS DOUBLE) END"
    zipped = f"list_transform(list_zip({part(1)}, {part(2)}, {part(3)}), lambda z: {{'w': z[1], 'n': z[2], 's': z[3]}})"
    return f"list_filter(list_transform({zipped}, lambda x: {{'value': {value} * CAST({scale} AS DOUBLE), 'before': trim(x.w)}}), lambda x: x.value IS NOT NULL)"


_SAID = "CASE " + " ".join(f"WHEN ends_with(' ' || b, ' {words}') THEN '{said}'" for words, said in text.QUALIFIERS.items()) + " END"


@query(320, 321, 322, sql=f"""WITH d AS (SELECT doc_id, {_told_sql('text')} AS told FROM documents),
asked AS (SELECT DISTINCT doc_id + 1 AS doc_id, x.value AS n FROM (SELECT doc_id, unnest(told) AS x FROM d)),
f AS (SELECT doc_id, n, list_filter(told, lambda x: x.value = n) AS same FROM asked JOIN d USING (doc_id)), g AS (SELECT doc_id, n, len(same) > 0 AS stated, same[1].before AS b FROM f)
SELECT doc_id, n, stated, {_SAID} AS qualifier FROM g""")
def stated_figures(spark, sf_dir):
    """Which numbers of the document before it a text tells, too, by their value, and what it says of them. Null texts tell
    nothing."""
    d = cut(table(spark, sf_dir, "documents").select("doc_id", text.told_numbers(F.col("text")).alias("told")))
    asked = d.select((F.col("doc_id") + 1).alias("doc_id"), F.explode(F.transform("told", lambda x: x["value"])).alias("n")).distinct()
    return d.join(asked, "doc_id").select("doc_id", "n", text.states(F.col("told"), F.col("n")).alias("stated"), text.qualifier_of(F.col("told"), F.col("n")).alias("qualifier"))


@query(382, sql=f"""WITH {_CARDS}, r AS (SELECT early, late, gap, shared, coalesce({_EVENT}, {_LOOSE}, {_TALK}) AS rule FROM p)
SELECT early, late, rule, gap > 10800 AND shared < 2 AS other FROM r WHERE rule IS NOT NULL""")
def late_strangers(spark, sf_dir):
    """Of the pairs that a rule joins, those over three hours apart with under two words in common: another story."""
    other = (F.col("at") - F.col("at_e") > 10_800) & (sets.shared(F.col("w"), F.col("w_e")) < 2)
    return matches(cards(spark, sf_dir), event() + loose() + talk(), other=other).drop("place")


_TOLD = f"""{_CARDS}, k AS (SELECT early, late, t, own, shared FROM p WHERE gap <= 43200)"""


def _tellers(spark, sf_dir, least, whose):
    """Pairs of a desk within 12 hours with so many headline words in common, and how many."""
    c = cards(spark, sf_dir).select("fp", "at", "source", "desk", "w")
    shared = sets.shared(F.col("w"), F.col("w_e"))
    rule = Rule("tells", 43_200, block(least, "desk"), (F.col("desk") == F.col("desk_e")) & whose & (shared >= least))
    return matches(c, [rule], t=F.col("at_e"), hits=shared).drop("place", "rule")


@query(132, sql=f"""WITH {_TOLD}, o AS (SELECT late, early, CAST(shared AS INTEGER) AS hits, row_number() OVER (PARTITION BY late ORDER BY shared DESC, t, early) AS place FROM k WHERE NOT own AND shared >= 3)
SELECT late, early, hits, CAST(place AS INTEGER) AS place FROM o WHERE place <= 5""")
def earlier_tellers(spark, sf_dir):
    """The five reports (the number is the feature) of other sources in the 12 hours before that carry most of a report's
    words, three at least; the earlier one first."""
    both = _tellers(spark, sf_dir, 3, F.col("source") != F.col("source_e"))
    order = Window.partitionBy("late").orderBy(F.desc("hits"), "t", "early")
    return both.withColumn("place", F.row_number().over(order)).filter("place <= 5").select("late", "early", "hits", "place")


@query(133, sql=f"""WITH {_TOLD}, o AS (SELECT late, early, shared, row_number() OVER (PARTITION BY late ORDER BY shared DESC, t DESC, early) AS place FROM k WHERE own AND shared >= 2)
SELECT late, early AS own, CAST(shared AS INTEGER) AS hits FROM o WHERE place = 1""")
def own_reads(spark, sf_dir):
    """The source's own report of the 12 hours before that has most words in common, two at least, of several the latest."""
    both = _tellers(spark, sf_dir, 2, F.col("source") == F.col("source_e"))
    best = both.groupBy("late").agg(F.min(F.struct((-F.col("hits")).alias("h"), (-F.col("t")).alias("t"), "early")).alias("b"))
    return best.select("late", F.col("b.early").alias("own"), (-F.col("b.h")).alias("hits"))


@query(200, 201, sql=f"""WITH {_CARDS}, k AS (SELECT fp, at_, concat_ws('|', desk, CASE WHEN len(f) > 0 THEN 'figures' ELSE 'words' END, at_ // 86400, at_ // 10800 % 8, speaker) AS story FROM c)
SELECT story, count(*) AS n, arg_min(fp, (at_, fp)) AS first_fp FROM k GROUP BY story""")
def story_keys(spark, sf_dir):
    """Reports by desk, kind, day, slot of three hours and speaker, with the first of each."""
    c = cards(spark, sf_dir)
    day, slot = F.floor(F.col("at") / 86_400), F.floor(F.col("at") / 10_800) % 8
    key = F.concat_ws("|", "desk", F.when(F.col("kind"), "figures").otherwise("words"), day, slot, "speaker")
    return c.groupBy(key.alias("story")).agg(F.count("*").alias("n"), F.min_by("fp", F.struct("at", "fp")).alias("first_fp"))


@query(417, sql=f"""WITH {_CARDS}, r AS (SELECT p.early, p.late, l.at_ // 21600 AS tick, l.at_ FROM p JOIN c l ON l.fp = p.late WHERE {_EVENT} IS NOT NULL),
h AS (SELECT tick, early, min((at_, late)) AS first FROM r GROUP BY 1, 2), o AS (SELECT tick, early, row_number() OVER (PARTITION BY tick ORDER BY first, early) AS k FROM h)
SELECT r.early, r.late, o.k <= 3 AS now FROM r JOIN o USING (tick, early)""")
def enriched_now(spark, sf_dir):
    """Pairs by the event rules of each tick of six hours: those of its first three homes are written now, the rest wait."""
    c = cards(spark, sf_dir)
    both = matches(c, event(), then=F.col("at")).select("early", "late", F.col("then").alias("at"), F.floor(F.col("then") / 21_600).alias("tick"))
    homes = both.groupBy("tick", "early").agg(F.min(F.struct("at", "late")).alias("first"))
    homes = homes.withColumn("k", F.row_number().over(Window.partitionBy("tick").orderBy("first", "early")))
    return both.join(homes, ["tick", "early"]).select("early", "late", (F.col("k") <= 3).alias("now"))
