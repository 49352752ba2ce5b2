"""Queries that match names: flags by number prefix, outlets by rank, destinations by tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog import query
from tideline.operators.matching import longest_prefix, ranked_prefix, tiered_match
from tideline.session import table

_NUMBER = "CAST(100000000 + c_custkey * 7919 * 37 % 800000000 AS BIGINT)"


@query(356, sql=f"""WITH t AS (
  SELECT CAST(200 + n_nationkey * 20 AS VARCHAR) AS prefix, n_name AS flag FROM nation UNION ALL SELECT CAST(2000 + s_suppkey * 7 % 6000 AS VARCHAR), 'S' || CAST(s_nationkey AS VARCHAR) FROM supplier
), one AS (SELECT prefix, min(flag) AS flag FROM t GROUP BY prefix), v AS (SELECT c_custkey, {_NUMBER} AS number FROM customer),
hit AS (SELECT v.c_custkey, max(struct_pack(n := length(prefix), p := prefix, f := flag)) AS m FROM v JOIN one ON starts_with(CAST(number AS VARCHAR), prefix) WHERE number BETWEEN 200000000 AND 799999999 GROUP BY 1)
SELECT v.c_custkey, number, m.p AS prefix, m.f AS flag FROM v LEFT JOIN hit USING (c_custkey)""")
def flags(spark, sf_dir):
    """Numbers with the flag of the longest prefix known; nine digits that begin with 2 to 7 count."""
    prefixes = table(spark, sf_dir, "nation").select((F.lit(200) + F.col("n_nationkey") * 20).cast("string").alias("prefix"), F.col("n_name").alias("flag")).unionByName(
        table(spark, sf_dir, "supplier").select((F.lit(2000) + F.col("s_suppkey") * 7 % 6000).cast("string").alias("prefix"), F.concat(F.lit("S"), "s_nationkey").alias("flag")))
    ships = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_NUMBER).alias("number"))
    able = ships.withColumn("own", F.when(F.col("number").between(200000000, 799999999), F.col("number")))
    return longest_prefix(able, "own", prefixes, "prefix").drop("own")


_BARE = "trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g'))"


@query(403, sql=f"""WITH v AS (SELECT s_suppkey, s_nationkey AS country, {_BARE.format("s_name")} AS v FROM supplier),
p AS (SELECT s_nationkey AS country, {_BARE.format("left(s_name, CAST(3 + s_suppkey * 5 % 16 AS INTEGER))")} AS p, CASE WHEN s_suppkey % 3 = 0 THEN 100 + s_suppkey ELSE s_suppkey END AS place FROM supplier)
SELECT v.s_suppkey, min(place) AS place FROM v LEFT JOIN p ON p.country = v.country AND length(p) >= 2 AND (v = p OR starts_with(v, p || ' ') OR (length(p) >= 4 AND starts_with(v, p))) GROUP BY 1""")
def press_ranks(spark, sf_dir):
    """Outlets with their place in their country's list, of names that they are or begin with; a later tier comes after."""
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "country")
    listed = s.select("country", F.left("s_name", (3 + F.col("s_suppkey") * 5 % 16).cast("int")).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, 100 + F.col("s_suppkey")).otherwise(F.col("s_suppkey")).alias("place"))
    return ranked_prefix(s.select("s_suppkey", "country", "s_name"), "s_name", ["country"], listed, "name", "place").select("s_suppkey", "place")


_PLACES = """p AS (SELECT p_partkey AS place, upper(p_name || ' ' || p_type) AS alias, 'A' || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS code FROM part),
  names AS (SELECT * FROM p UNION ALL SELECT p_partkey + 10000000, upper(p_brand || p_type), NULL FROM part)"""
_ASKED = """asked AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN alias WHEN 1 THEN lower(alias) || ' anch.' WHEN 2 THEN 'VIA ' || alias WHEN 3 THEN 'PILOT ' || alias || ' ROADS' WHEN 4 THEN 'OMSOH>' || code
    WHEN 5 THEN substr(code, 1, 2) || ' ' || substr(code, 3, 3) WHEN 6 THEN replace(alias, ' ', '') || 'X' WHEN 7 THEN alias || ' TO ORDERS' END AS dest FROM orders JOIN p ON place = o_custkey)"""


@query(118, sql=rf"""WITH {_PLACES}, {_ASKED}, d AS (
  SELECT DISTINCT dest, {_BARE.format("dest")} AS d, {_BARE.format(r"regexp_replace(upper(dest), '^.*(>|=|\bTO\b)', '')")} AS tail FROM asked WHERE dest IS NOT NULL
), a AS (SELECT {_BARE.format("alias")} AS a, min(place) AS place FROM names GROUP BY 1), c AS (SELECT code, min(place) AS place FROM p GROUP BY 1),
told AS (SELECT dest, unnest(list_transform(l, lambda x: replace(x, ' ', ''))) AS code, unnest(range(len(l))) AS i FROM (SELECT dest, regexp_extract_all(d, '\b([A-Z]{{2}} ?[A-Z0-9]{{3}})\b', 1) AS l FROM d)),
m AS (
  SELECT dest, 0 AS tier, -i AS less, place FROM told JOIN c USING (code) UNION ALL
  SELECT dest, t, -length(a), place FROM (SELECT dest, a, place, unnest([
      CASE WHEN tail = a THEN 1 WHEN starts_with(tail, a || ' ') THEN 2 WHEN ends_with(tail, ' ' || a) THEN 3 WHEN contains(tail, ' ' || a || ' ') THEN 4 END,
      CASE WHEN d = a THEN 5 WHEN starts_with(d, a || ' ') THEN 6 WHEN ends_with(d, ' ' || a) THEN 7 WHEN contains(d, ' ' || a || ' ') THEN 8 END,
      CASE WHEN length(a) >= 5 AND contains(replace(d, ' ', ''), replace(a, ' ', '')) THEN 9 END]) AS t FROM d, a) WHERE t IS NOT NULL
), best AS (SELECT dest, min(struct_pack(t := tier, l := less, p := place)) AS b FROM m GROUP BY dest)
SELECT o_orderkey, b.p AS place, b.t AS tier FROM asked LEFT JOIN best USING (dest)""")
def destinations(spark, sf_dir):
    """Free-text destinations of orders, each with the place of its best tier."""
    part = table(spark, sf_dir, "part")
    p = part.select(
        F.col("p_partkey").alias("place"), F.upper(F.concat_ws(" ", "p_name", "p_type")).alias("alias"),
        F.concat(F.lit("A"), F.char((65 + F.col("p_partkey") % 26)), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")).alias("code"),
    )
    names = p.unionByName(part.select((F.col("p_partkey") + 10_000_000).alias("place"), F.upper(F.concat("p_brand", "p_type")).alias("alias"), F.lit(None).cast("string").alias("code")))
    k = F.col("o_orderkey") % 9
    said = (
        F.when(k == 0, F.col("alias")).when(k == 1, F.concat(F.lower("alias"), F.lit(" anch."))).when(k == 2, F.concat(F.lit("VIA "), "alias")).when(k == 3, F.concat(F.lit("PILOT "), "alias", F.lit(" ROADS")))
        .when(k == 4, F.concat(F.lit("OMSOH>"), "code")).when(k == 5, F.concat(F.substr("code", F.lit(1), F.lit(2)), F.lit(" "), F.substr("code", F.lit(3), F.lit(3))))
        .when(k == 6, F.concat(F.replace("alias", F.lit(" "), F.lit("")), F.lit("X"))).when(k == 7, F.concat("alias", F.lit(" TO ORDERS")))
    )
    asked = table(spark, sf_dir, "orders").join(p, F.col("o_custkey") == F.col("place")).select("o_orderkey", said.alias("dest"))
    return tiered_match(asked, "dest", names).select("o_orderkey", "place", "tier")
