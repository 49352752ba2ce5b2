"""URL filter by path-template trees, in DataFrame operations only.

Per host the path segments make a tree, as deep as paths branch.  Numbers, hex strings and words with digits are variable at sight;
of the other children of a node those with under 1/20 of its pages become the wildcard `*` where it has more than
`most_children`.  Sibling branches with the same kinds of children whose labelled shares do not differ significantly
(two proportions, 95 %, add-one smoothing) merge into one branch, named `~` and the kinds.  A template is the path of
labels; it is rejected when its smoothed purity, (good + strength * prior) / (labelled + strength) with the share of good
pages overall as prior, is under `least_purity`.  Explicit rules go first: the longest that fits a page decides.

Pages are aggregated by host and shaped path before anything is joined, and every step is a grouping and a lookup by key:
a host with a third of all pages is spread over its paths.  A level of the tree is a few groupings; levels go on while any
node has two different paths and a labelled page below it.  What follows in a path that is alone under its node is taken as
it is, and all below a node without a labelled page is one template, `/**`: its purity is the prior, however it is split.

Defined results: a null url and one without `://` have empty host and path; the host ends before the first `/`, `?` or
`#` and A-Z is lower-cased; unlabelled pages count for the tree, not for purity; a page labelled twice counts twice;
repeated rows are judged alike; columns named like the added columns are replaced, others pass through.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.scratch import Scratch

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("host", "path", "rule", "verdict", "template", "purity")
#: Rules are a chain of conditions in the plan; more than this many belong in a table.
MOST_RULES = 1000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], verdict: bool = False) -> Column:
    """The longest rule (host, path, verdict) that fits, as host + path, or its verdict; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.lit(v if verdict else h + p)).otherwise(out)
    return out


def _shape(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"^[0-9]+(\.[a-z]+)?$"), "{n}").when(segment.rlike(r"^[0-9a-f-]{8,}$"), "{h}")
        .when(segment.rlike(r"[0-9]"), "{a}").otherwise(segment)
    )


def _kind(shape: Column) -> Column:
    return F.when(shape.isNull(), ".").when(shape.isin("{n}", "{h}", "{a}"), shape).otherwise("w")


def templates(scratch: Scratch, shaped: DataFrame, most_children: int) -> DataFrame:
    """shaped (host, shapes, n, good, bad), one row a host and shaped path, with the template of each. The table is cut from
    its lineage after each level, since the next one reads it several times."""
    tree, done, k = shaped.withColumn("prefix", F.lit("")), [], 0
    while True:
        k += 1
        longer = F.size("shapes") >= k
        below = tree.filter(longer).groupBy("host", "prefix").agg(F.count("*").alias("paths"), F.sum(F.col("good") + F.col("bad")).alias("marks"))
        tree = scratch.put(tree.join(below, ["host", "prefix"], "left").withColumn("ended", ~longer | (F.col("paths") < 2) | (F.col("marks") == 0)))
        rest = F.slice("shapes", k, F.greatest(F.size("shapes") - k + 1, F.lit(0)))
        done.append(tree.filter("ended").withColumn("template", F.concat("prefix", F.when(~longer, "").when(F.col("marks") == 0, "/**").otherwise(F.concat(F.lit("/"), F.array_join(rest, "/"))))).drop("prefix", "paths", "marks", "ended"))
        here = tree.filter("not ended").drop("paths", "marks", "ended")
        if here.isEmpty():
            break
        here = here.withColumn("own", F.get("shapes", F.lit(k - 1)))
        branch = here.groupBy("host", "prefix", "own").agg(F.sum("n").alias("bn"))
        parent = branch.groupBy("host", "prefix").agg(F.count("*").alias("children"), F.sum("bn").alias("pn"))
        label = F.when((F.col("children") > most_children) & (F.col("bn") * 20 < F.col("pn")) & ~F.col("own").isin("{n}", "{h}", "{a}"), "*").otherwise(F.col("own"))
        label = scratch.put(branch.join(parent, ["host", "prefix"]).select("host", "prefix", "own", label.alias("label")))
        node = scratch.put(
            here.join(label, ["host", "prefix", "own"]).groupBy("host", "prefix", "label")
            .agg(F.array_join(F.array_sort(F.collect_set(_kind(F.get("shapes", F.lit(k))))), ",").alias("kinds"), F.sum("good").alias("g"), F.sum("bad").alias("b"))
        )
        pool = node.groupBy("host", "prefix", "kinds").agg(F.count("*").alias("m"), F.sum("g").alias("pg"), F.sum("b").alias("pb"))
        rest_n = F.col("pg") - F.col("g") + F.col("pb") - F.col("b")
        r1, r2 = (F.col("b") + 1) / (F.col("g") + F.col("b") + 2), (F.col("pb") - F.col("b") + 1) / (rest_n + 2)
        error = F.sqrt(r1 * (1 - r1) / (F.col("g") + F.col("b") + 2) + r2 * (1 - r2) / (rest_n + 2))
        merged = F.when((F.col("m") > 1) & (F.abs(r1 - r2) <= 1.96 * error), F.concat(F.lit("~"), "kinds")).otherwise(F.col("label"))
        merged = node.join(pool, ["host", "prefix", "kinds"]).select("host", "prefix", "label", merged.alias("merged"))
        named = label.join(merged, ["host", "prefix", "label"]).select("host", "prefix", "own", "merged")
        tree = here.join(named, ["host", "prefix", "own"]).withColumn("prefix", F.concat("prefix", F.lit("/"), "merged")).drop("own", "merged")
    return functools.reduce(DataFrame.unionByName, done)


def judge(
    spark: SparkSession, pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", good_col: str = "good",
    most_children: int = 8, strength: float = 2.0, least_purity: float = 0.5,
) -> DataFrame:
    """pages with host, path, rule, verdict, template and purity; labelled: (id, good boolean) of some pages."""
    kept = [c for c in pages.columns if c not in ADDED]
    url = F.col(f"`{url_col}`")
    segments = F.filter(F.split(F.col("path"), "/"), lambda x: x != "")
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("shapes", F.transform(segments, _shape))
    path_key = ["host", "shapes"]
    marks = labelled.filter(F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.count_if(F.col(good_col)).alias("good"), F.count_if(~F.col(good_col)).alias("bad"))
    counted = (
        rows.select(F.col(f"`{id_col}`").alias("_id"), *path_key).join(marks, "_id", "left")
        .groupBy(*path_key).agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    scratch = Scratch(spark, "url-templates")
    counted = scratch.put(counted)
    tree = scratch.put(templates(scratch, counted, most_children))
    prior = counted.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("good"), F.lit(0)) + F.coalesce(F.sum("bad"), F.lit(0)) + 2)).alias("prior"))  # one row
    purity = tree.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).crossJoin(F.broadcast(prior))
    purity = purity.select("host", "template", ((F.col("g") + strength * F.col("prior")) / (F.col("g") + F.col("b") + strength)).alias("purity"))
    found = tree.join(purity, ["host", "template"]).select(*(F.col(c).alias(f"_{c}") for c in path_key), "template", "purity")
    same = [F.col(c) == F.col(f"_{c}") for c in path_key]
    joined = rows.join(found, same, "left")
    verdict = F.coalesce(rule_of(F.col("host"), F.col("path"), rules, True), F.when(F.col("purity") < least_purity, "block").otherwise("allow"))
    return joined.select(*(F.col(f"`{c}`") for c in kept), "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), verdict.alias("verdict"), "template", "purity")


def sql(rules: list[tuple[str, str, str]], levels: int = 8, most_children: int = 8) -> str:
    """The same as DuckDB SQL over pages (page_id, url) and labels (doc_id, quality), for paths of at most `levels` segments."""
    fits = {r: f"((host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}'))" for r in rules}
    chain = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r[0]}{r[1]}'" for r in chain) + " END"
    decided = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r[2]}'" for r in chain) + " END"
    shape = "CASE WHEN regexp_matches({0}, '^[0-9]+(\\.[a-z]+)?$') THEN '{{n}}' WHEN regexp_matches({0}, '^[0-9a-f-]{{8,}}$') THEN '{{h}}' WHEN regexp_matches({0}, '[0-9]') THEN '{{a}}' ELSE {0} END"
    keys = ", ".join(f"s{k}" for k in range(1, levels + 1))
    out = [
        f"""WITH parsed AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_SMALL}'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
        "cut AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM parsed)",
        "rows_ AS (SELECT page_id, host, path, " + ", ".join(f"{shape.format(f'seg[{k}]')} AS s{k}" for k in range(1, levels + 1)) + " FROM cut)",
        "marks AS (SELECT doc_id, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality <> 1) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id)",
        f"t0 AS (SELECT host, {keys}, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad, '' AS prefix, false AS fin FROM rows_ LEFT JOIN marks ON doc_id = page_id GROUP BY ALL)",
    ]
    for k in range(1, levels + 1):
        s, nxt = f"s{k}", f"s{k + 1}" if k < levels else "CAST(NULL AS VARCHAR)"
        kind = f"CASE WHEN {nxt} IS NULL THEN '.' WHEN {nxt} IN ('{{n}}', '{{h}}', '{{a}}') THEN {nxt} ELSE 'w' END"
        out += [
            f"u{k} AS (SELECT *, NOT fin AND {s} IS NOT NULL AND sum(CASE WHEN {s} IS NULL THEN 0 ELSE good + bad END) OVER (PARTITION BY host, prefix, fin) = 0 AS bare FROM t{k - 1})",
            f"v{k} AS (SELECT * EXCLUDE (bare) REPLACE (CASE WHEN bare THEN prefix || '/**' ELSE prefix END AS prefix, fin OR bare AS fin) FROM u{k})",
            f"b{k} AS (SELECT host, prefix, {s}, sum(n) AS bn FROM v{k} WHERE {s} IS NOT NULL AND NOT fin GROUP BY ALL)",
            f"""l{k} AS (SELECT host, prefix, {s}, CASE WHEN count(*) OVER (PARTITION BY host, prefix) > {most_children} AND bn * 20 < sum(bn) OVER (PARTITION BY host, prefix)
  AND {s} NOT IN ('{{n}}', '{{h}}', '{{a}}') THEN '*' ELSE {s} END AS label FROM b{k})""",
            f"""n{k} AS (SELECT host, prefix, label, array_to_string(list_sort(list(DISTINCT {kind})), ',') AS kinds, sum(good) AS g, sum(bad) AS b
  FROM v{k} JOIN l{k} USING (host, prefix, {s}) WHERE NOT fin GROUP BY host, prefix, label)""",
            f"p{k} AS (SELECT *, count(*) OVER own AS m, sum(g) OVER own - g AS rg, sum(b) OVER own - b AS rb FROM n{k} WINDOW own AS (PARTITION BY host, prefix, kinds))",
            f"r{k} AS (SELECT *, CAST(b + 1 AS DOUBLE) / (g + b + 2) AS r1, CAST(rb + 1 AS DOUBLE) / (rg + rb + 2) AS r2 FROM p{k})",
            f"""m{k} AS (SELECT host, prefix, label, CASE WHEN m > 1 AND abs(r1 - r2) <= 1.96 * sqrt(r1 * (1 - r1) / (g + b + 2) + r2 * (1 - r2) / (rg + rb + 2))
  THEN '~' || kinds ELSE label END AS merged FROM r{k})""",
            f"""t{k} AS (SELECT * EXCLUDE (prefix, label, merged), CASE WHEN merged IS NULL THEN prefix ELSE prefix || '/' || merged END AS prefix
  FROM v{k} LEFT JOIN l{k} USING (host, prefix, {s}) LEFT JOIN m{k} USING (host, prefix, label))""",
        ]
    out += [
        f"named AS (SELECT *, prefix AS template FROM t{levels})",
        "prior AS (SELECT CAST(coalesce(sum(good), 0) + 1 AS DOUBLE) / (coalesce(sum(good), 0) + coalesce(sum(bad), 0) + 2) AS prior FROM t0)",
        "pure AS (SELECT host, template, (sum(good) + 2.0 * any_value(prior)) / (sum(good) + sum(bad) + 2.0) AS purity FROM named, prior GROUP BY host, template)",
    ]
    same = " AND ".join(f"r.{c} IS NOT DISTINCT FROM x.{c}" for c in ["host", *(f"s{k}" for k in range(1, levels + 1))])
    return (
        ",\n".join(out) + f"""
SELECT page_id, host, path, {rule} AS rule, coalesce({decided}, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template
FROM (SELECT r.page_id, r.host, r.path, x.template, p.purity FROM rows_ r LEFT JOIN named x ON {same} LEFT JOIN pure p ON p.host = x.host AND p.template = x.template)"""
    )
