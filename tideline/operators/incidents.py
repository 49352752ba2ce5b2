"""The first earlier report of the same incident, by equi-keys and time: no pair of reports is made.

Two reports may match in several ways (equal figures, figures one apart, totals against sums, neighbouring seas, a kind or
cause that one of them does not tell). Every way is a key: a report offers the keys it can be found by and asks for those it
may match. Within a key and a stretch of time as long as the window, offers and asks are sorted by time, and a running
minimum gives each ask the first offer of the window; the least over a report's keys is its answer. So work grows with the
keys a report has, not with how many others share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_earlier(reports: DataFrame, key: str, at: str, offers: Column, asks: Column, within: int) -> DataFrame:
    """(key, first, first_at): of each report the earliest other one, by time and key, that offers a key it asks for and is
    at most `within` seconds older, or as old with a lesser key. Reports without any have no row.

    offers and asks are arrays of keys of one type; null keys match nothing, a null time neither. Repeated keys of reports count once."""
    own = reports.filter(F.col(at).isNotNull()).dropDuplicates([key])
    t = F.col(at).cast("long")
    b = F.floor(t / within)
    told = lambda k, b, ask: F.struct(k.alias("k"), b.alias("b"), F.lit(ask).alias("ask"))
    offered = F.transform(F.array_distinct(offers), lambda k: told(k, b, 0))
    asked = F.flatten(F.transform(F.array_distinct(asks), lambda k: F.array(told(k, b, 1), told(k, b - 1, 1))))
    # Outer, since Spark would otherwise work out all keys a second time, to see whether there are any.
    keys = own.select(F.col(key).alias("id"), t.alias("t"), F.flatten(F.array_compact(F.array(offered, asked))).alias("keys"))
    both = keys.select("id", "t", F.inline_outer("keys")).filter("k is not null")
    offer = F.when(F.col("ask") == 0, F.struct("t", "id"))
    # In the ask's own stretch every offer up to its second is in time; the least of them may be the report itself or, at its
    # own second, one with a greater key: then none is earlier.
    upto = Window.partitionBy("k", "b").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    before = (F.col("m.t") < F.col("t")) | ((F.col("m.t") == F.col("t")) & (F.col("m.id") < F.col("id")))
    # Of the stretch before all offers are earlier, and those in time that count to the ask's second or longer: in falling
    # order of the last second at which they count, so that this frame only grows, too.
    last = F.when(F.col("ask") == 0, F.col("t") + within).otherwise(F.col("t"))
    from_ = Window.partitionBy("k", "b").orderBy(F.desc("last")).rangeBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last", last).withColumns({"m": F.min(offer).over(upto), "p": F.min(offer).over(from_)}).filter("ask = 1")
    here = F.floor(F.col("t") / within) == F.col("b")
    found = seen.select("id", F.when(~here, F.col("p")).when(before, F.col("m")).alias("m")).filter("m is not null")
    return found.groupBy("id").agg(F.min("m").alias("m")).select(F.col("id").alias(key), F.col("m.id").alias("first"), F.col("m.t").alias("first_at"))


def toll_keys(place: Column, toll: Column) -> tuple[Column, Column]:
    """Keys of tolls of one place that meet: a figure of the dead in common, or one apart from three up; no dead but a figure
    of the hurt in common; a total that is the other's total or the sum of its first dead and hurt."""
    dead, hurt, total = toll["dead"], toll["hurt"], toll["total"]
    of = lambda kind, numbers: F.transform(numbers, lambda n: F.concat_ws("|", place, F.lit(kind), n))
    none = F.array().cast("array<int>")
    alone = F.when(F.size(dead) == 0, hurt).otherwise(none)
    sums = F.concat(total, F.when((F.size(dead) > 0) & (F.size(hurt) > 0), F.array(F.get(dead, F.lit(0)) + F.get(hurt, F.lit(0)))).otherwise(none))
    apart = F.concat(dead, F.flatten(F.transform(dead, lambda n: F.when(n > 3, F.array(n - 1, n + 1)).when(n == 3, F.array(n + 1)).otherwise(none))))
    held = lambda keys: F.when(place.isNotNull(), keys)
    return held(F.concat(of("d", dead), of("h", alone), of("t", total), of("s", sums))), held(F.concat(of("d", apart), of("h", alone), of("s", total), of("t", sums)))


def ship_keys(ship: Column, neighbours: dict[str, list[str]], general: str = "ship") -> tuple[Column, Column]:
    """Keys of ship incidents that may be one: the same name; or, unless both have names, the same or a neighbouring sea with
    kinds and causes that do not differ (not told, or the general kind, differs from nothing); or, where one tells no sea,
    the same particular kind and the same cause."""
    kind, sea, name, cause = (F.coalesce(ship[f], F.lit("")) for f in ("kind", "sea", "name", "cause"))
    both = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws("|", x, y))))
    offered = lambda x: F.array(x, F.lit("*"))
    asked = lambda x, blank: F.when(x == blank, F.array(F.lit("*"))).otherwise(F.array(x, F.lit(blank)))
    near = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*(F.lit(y) for y in x)) for pair in neighbours.items() for x in pair))
    seas = F.concat(F.array(sea), F.coalesce(F.element_at(near, sea), F.array().cast("array<string>")))
    at_sea = F.when(sea != "", both(F.array(sea), both(both(offered(kind), offered(cause)), offered(name))))
    ask_sea = F.when(sea != "", both(seas, both(both(asked(kind, general), asked(cause, "")), F.when(name == "", F.array(F.lit("*"))).otherwise(F.array(F.lit(""))))))
    named = F.when(name != "", F.array(F.concat(F.lit("name|"), name)))
    told = (kind != general) & (kind != "") & (cause != "")
    no_sea = F.when(told, both(both(F.array(F.concat(F.lit("any|"), kind)), F.array(cause)), both(offered(F.when(sea == "", "none").otherwise("sea")), offered(name))))
    ask_no_sea = F.when(told, both(both(F.array(F.concat(F.lit("any|"), kind)), F.array(cause)), both(F.array(F.when(sea == "", "*").otherwise("none")), F.when(name == "", F.array(F.lit("*"))).otherwise(F.array(F.lit(""))))))
    all_of = lambda *keys: F.when(ship.isNotNull(), F.flatten(F.array_compact(F.array(*keys))))
    return all_of(at_sea, named, no_sea), all_of(ask_sea, named, ask_no_sea)
