"""Queries of incidents: tolls and ships read off headlines, and the first earlier report of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.functions import incidents as I
from tideline.operators.incidents import first_earlier, ship_keys, toll_keys
from tideline.session import POSITIONS, positions

_FORMS = 12
#: Headlines with the figures n and k, and what each counts: total, dead, hurt.
_TOLD = [
    ("Strike kills {n} and wounds {k} in {p}", ("", "{n}", "{k}")), ("{N} killed and {k} injured in {p}", ("", "{n}", "{k}")), ("Shelling kills and wounds {n} people at {p}", ("{n}", "", "")),
    ("{N} people killed or wounded in {p}, {k} hurt later", ("{n}", "", "{k}")), ("Casualty toll rises to {n} in {p}", ("{n}", "", "")), ("Drone kills a civilian shepherd near {p}", ("", "1", "")),
    ("At least {n} soldiers dead, more than {k} others wounded", ("", "{n}", "{k}")), ("Raid wounds {k} citizens, none killed", ("", "", "{k}")), ("Fisherman was killed off {p}", ("", "1", "")),
    ("{k} drones shot down over {p}", ("", "", "")), ("Clashes in {p} on day {n}", ("", "", "")), (None, ("", "", "")),
]
_N, _K, _P = "(event_id * 7 % 23 + 1)", "(event_id * 5 % 9 + 1)", "(user_id % 40)"


def spread(rows):
    """rows dealt out by id: a file of events is small for the time that reading their headlines takes, so its splits are few."""
    return rows.repartition("event_id")


def _sql_text(t: str | None) -> str:
    if t is None:
        return "CAST(NULL AS VARCHAR)"
    words = "[" + ", ".join(f"'{w.capitalize()}'" for w in I.NUMBERS) + "]"
    for mark, value in (("{n}", f"CAST({_N} AS VARCHAR)"), ("{k}", f"CAST({_K} AS VARCHAR)"), ("{p}", f"'P' || CAST({_P} AS VARCHAR)"), ("{N}", f"CASE WHEN {_N} <= {len(I.NUMBERS)} THEN {words}[{_N}] ELSE CAST({_N} AS VARCHAR) END")):
        t = t.replace(mark, f"' || {value} || '")
    return f"'{t}'"


def _headlines(spark, sf_dir):
    words = F.array(*(F.lit(w.capitalize()) for w in I.NUMBERS))
    e = positions(spark, sf_dir).select("event_id", "t", F.col("key").alias("user_id"), (F.col("event_id") * 7 % 23 + 1).alias("n"), (F.col("event_id") * 5 % 9 + 1).alias("k"))
    values = {"n": F.col("n").cast("string"), "k": F.col("k").cast("string"), "p": F.concat(F.lit("P"), F.col("user_id") % 40), "N": F.coalesce(F.get(words, (F.col("n") - 1).cast("int")), F.col("n").cast("string"))}
    said = F.lit(None).cast("string")
    for form, (text, _) in enumerate(_TOLD):
        if text is not None:
            line = F.lit(text)
            for mark, value in values.items():
                line = F.replace(line, F.lit("{" + mark + "}"), value)
            said = F.when(F.col("event_id") % _FORMS == form, line).otherwise(said)
    return spread(e).select("event_id", "t", F.concat(F.lit("P"), F.col("user_id") % 40).alias("place"), said.alias("headline"))


def _figures_sql(k: int) -> str:
    cases = " ".join(f"WHEN {f} THEN " + (f"[{c[k].replace('{n}', _N).replace('{k}', _K)}]" if c[k] else "[]") for f, (_, c) in enumerate(_TOLD))
    return f"list_transform(CASE event_id % {_FORMS} {cases} END, lambda x: CAST(x AS INTEGER))"


@query(174, 420, sql=f"""SELECT event_id, array_to_string({_figures_sql(0)}, ',') AS total, array_to_string({_figures_sql(1)}, ',') AS dead, array_to_string({_figures_sql(2)}, ',') AS hurt,
  CASE event_id % {_FORMS} WHEN 5 THEN 'civilians' WHEN 6 THEN 'soldiers' WHEN 7 THEN 'civilians' END AS victims FROM events""")
def tolls_told(spark, sf_dir):
    """The dead, hurt and totals that headlines count, each figure once, and whose they are."""
    h = _headlines(spark, sf_dir).withColumn("toll", I.toll_of(F.col("headline")))
    listed = lambda f: F.array_join(F.transform(F.col("toll")[f], lambda n: n.cast("string")), ",").alias(f)
    return h.select("event_id", listed("total"), listed("dead"), listed("hurt"), I.victims(F.col("headline")).alias("victims"))


_HALF_DAY = 12 * 3600


@query(176, 187, sql=f"""WITH {POSITIONS}, c AS (
  SELECT event_id, t, key % 40 AS place, {_figures_sql(0)} AS total, {_figures_sql(1)} AS dead, {_figures_sql(2)} AS hurt FROM (SELECT *, key AS user_id FROM positions)
), s AS (SELECT *, CASE WHEN len(dead) > 0 AND len(hurt) > 0 THEN list_append(total, dead[1] + hurt[1]) ELSE total END AS sums FROM c)
SELECT b.event_id, arg_min(a.event_id, (a.t, a.event_id)) AS first, min(a.t) AS first_at FROM s b JOIN s a ON a.place = b.place AND b.t - a.t BETWEEN 0 AND {_HALF_DAY} AND (a.t < b.t OR a.event_id < b.event_id)
 AND (len(list_filter(a.dead, lambda n: len(list_filter(b.dead, lambda m: n = m OR (least(n, m) >= 3 AND abs(n - m) <= 1))) > 0)) > 0 OR (len(a.dead) = 0 AND len(b.dead) = 0 AND list_has_any(a.hurt, b.hurt))
  OR list_has_any(a.total, b.sums) OR list_has_any(b.total, a.sums)) GROUP BY 1""")
def same_tolls(spark, sf_dir):
    """Of each headline the first one of the place within half a day whose toll it tells, too."""
    h = _headlines(spark, sf_dir).withColumn("toll", I.toll_of(F.col("headline")))
    return first_earlier(h, "event_id", "t", *toll_keys(F.col("place"), F.col("toll")), within=_HALF_DAY)


_SEAS = [("red", r"\bred sea\b"), ("bab", r"\bmandab\b"), ("aden", r"\bgulf of aden\b"), ("gulf", r"\bpersian gulf\b")]
_NEAR = {"red": ["bab"], "bab": ["red", "aden"], "aden": ["bab"]}
_SHIP = """s AS (SELECT event_id, t, ['tanker', 'carrier', 'ship'][event_id % 3 + 1] AS kind, [NULL, 'red', 'bab', 'aden', 'gulf'][event_id // 3 % 5 + 1] AS sea,
  CASE WHEN event_id % 4 = 0 THEN 'astra' || CAST(event_id % 13 AS VARCHAR) END AS name, ['mine', 'projectile', NULL, 'seizure'][event_id // 5 % 4 + 1] AS cause FROM positions WHERE event_id % 11 <> 7),
  v AS (SELECT * FROM s WHERE coalesce(sea, name, cause) IS NOT NULL)"""


def _ships(spark, sf_dir):
    pick = lambda k, words: F.element_at(F.array(*(F.lit(w) for w in words)), (k % len(words) + 1).cast("int"))
    i = F.col("event_id")
    name = F.when(i % 4 == 0, F.concat(F.lit(" MV Astra-"), i % 13)).otherwise("")
    sea = pick(F.floor(i / 3), (" today", " in the Red Sea", " off Bab al-Mandab", " in the Gulf of Aden", " in the Persian Gulf"))
    cause = pick(F.floor(i / 5), (" by a sea mine", " by two missiles", "", " and boarded by none, crew detained"))
    line = F.when(i % 11 == 7, F.concat(F.lit("Oil price of a "), pick(i, ("tanker", "bulk carrier", "ship")), F.lit(" load rises"), sea)).otherwise(F.concat(pick(i, ("Tanker", "Bulk carrier", "Vessel")), name, F.lit(" hit"), cause, sea))
    return spread(positions(spark, sf_dir).select("event_id", "t")).select("event_id", "t", line.alias("headline"))


@query(172, sql=f"""WITH {POSITIONS}, {_SHIP} SELECT event_id, kind, sea, name, cause FROM v""")
def ship_incidents(spark, sf_dir):
    """Ships that headlines tell of an attack on, by kind, sea, name and cause."""
    return _ships(spark, sf_dir).select("event_id", I.ship_incident(F.col("headline"), _SEAS).alias("s")).filter("s is not null").select("event_id", "s.*")


@query(173, 105, sql=f"""WITH {POSITIONS}, {_SHIP}
SELECT b.event_id, arg_min(a.event_id, (a.t, a.event_id)) AS first, min(a.t) AS first_at FROM v b JOIN v a ON b.t - a.t BETWEEN 0 AND 10800 AND (a.t < b.t OR a.event_id < b.event_id)
 AND CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN a.name = b.name WHEN a.sea IS NULL OR b.sea IS NULL THEN a.kind = b.kind AND a.kind <> 'ship' AND coalesce(a.cause = b.cause, FALSE)
  ELSE (a.sea = b.sea OR (a.sea = 'bab' AND b.sea IN ('red', 'aden')) OR (b.sea = 'bab' AND a.sea IN ('red', 'aden'))) AND (a.kind = b.kind OR a.kind = 'ship' OR b.kind = 'ship') AND coalesce(a.cause = b.cause, TRUE) END GROUP BY 1""")
def same_ships(spark, sf_dir):
    """Of each ship's headline the first one within three hours that may tell of the same attack."""
    s = _ships(spark, sf_dir).select("event_id", "t", I.ship_incident(F.col("headline"), _SEAS).alias("s"))
    return first_earlier(s, "event_id", "t", *ship_keys(F.col("s"), _NEAR), within=3 * 3600)


@query(179, sql=f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'nation_' || CAST(o_custkey % 25 AS VARCHAR) || ' ' || CAST(o_custkey % 90 AS VARCHAR) || ' billion' WHEN 1 THEN 'nation_' || CAST(o_custkey % 25 AS VARCHAR) || ' ' || CAST(o_custkey % 90 AS VARCHAR) || '.5 million' END AS sum FROM orders""")
def sums_told(spark, sf_dir):
    """Sums of dollars by the first country named."""
    o, nation = positions_of_orders(spark, sf_dir), [f"NATION_{k}" for k in range(25)]
    return o.select("o_orderkey", I.money_key(F.col("headline"), sorted(nation, key=len, reverse=True)).alias("sum"))


def positions_of_orders(spark, sf_dir):
    from tideline.session import table

    n, a, k = F.concat(F.lit("NATION_"), F.col("o_custkey") % 25), F.col("o_custkey") % 90, F.col("o_orderkey") % 5
    line = F.when(k == 0, F.concat(n, F.lit(" says it lost $"), a, F.lit("bn, not NATION_3"))).when(k == 1, F.concat(F.lit("USD "), a, F.lit(".5 million for "), n)).when(k == 2, F.concat(F.lit("$"), a, F.lit(" for "), n)).when(k == 3, F.concat(F.lit("$ "), a, F.lit(" billion at sea")))
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("headline"))
