"""Joins that Spark has no operator for: interval and as-of joins by time bucket, nearest neighbour by grid cell,
dictionary lookups by word run, overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.geo import km
from tideline.lineage import cut


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, back: int, ahead: int = 0, suffix: str = "_r") -> DataFrame:
    """Pairs with equal keys and right time in [left time - back, left time + ahead] (seconds).

    Time is cut into buckets as long as the interval; the left row goes to the buckets it reaches (two or three), so the
    join is an equi-join on key and bucket and a busy key is spread over time. Rows without a key or time pair with nothing;
    repeated rows pair each; an empty side gives no pairs.
    """
    size = max(1, back + ahead)
    r = right.select(*(F.col(k) for k in keys), *(F.col(c).alias(c + suffix) for c in right.columns if c not in keys)).withColumn("_b", F.floor(F.col(at + suffix) / size))
    first, last = F.floor((F.col(at) - back) / size), F.floor((F.col(at) + ahead) / size)
    l_ = left.withColumn("_b", F.explode(F.sequence(first, last)))
    return l_.join(r, [*keys, "_b"]).filter(F.col(at + suffix).between(F.col(at) - back, F.col(at) + ahead)).drop("_b")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, *, within: int | None = None, strict: bool = False) -> DataFrame:
    """left with the value of the latest right row of its key at or before its time (strictly before with `strict`): one
    union, one sort by key and time, no join. Of right rows at one time any one counts, so let times of a key be distinct; left
    rows are kept as they are, repeated or without a key (null keys meet null keys); without a right row the columns are null."""
    tag = F.lit(1 if strict else 0)
    both = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_t": F.lit(None).cast("long"), "_left": F.lit(True), "_o": 1 - tag})
    more = right.select(*keys, at, F.col(value).alias("_v"), F.col(at).cast("long").alias("_t"), F.lit(False).alias("_left"), tag.alias("_o"))
    w = Window.partitionBy(*keys).orderBy(at, "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(~F.col("_left"), F.struct(F.col("_v").alias("v"), F.col("_t").alias("t"))), True).over(w)
    out = both.unionByName(more, allowMissingColumns=True).withColumn("_s", seen).filter("_left")
    fresh = F.lit(True) if within is None else F.col(at) - F.col("_s.t") <= within
    return out.withColumns({f"{value}_asof": F.when(fresh, F.col("_s.v")), f"{at}_asof": F.when(fresh, F.col("_s.t"))}).drop("_v", "_t", "_left", "_o", "_s")


def latest_of_others(rows: DataFrame, keys: list[str], at: str, id_: str, other: str, within: int) -> DataFrame:
    """(id, parent): of each row the latest earlier row (by time, then id) of its keys whose `other` differs, at most `within`
    seconds before, strictly earlier in time. Rows without one are left out.

    No pairs are made. Rows are summed up by second: the last row of a second, and the last whose `other` differs from
    that one's. Going over the seconds, the latest row is that of the second before; where it is of the row's own kind, the
    answer is the latest of another kind, which is the second's own second-best or else handed on from the second before.
    Stretches of time as long as the window keep a busy key from being one sort; a second stands in its own and the next."""
    per = rows.groupBy(*keys, at, other).agg(F.max(id_).alias(id_)).groupBy(*keys, at).agg(F.array_sort(F.collect_list(F.struct(F.col(id_).alias("id"), F.col(other).alias("o")))).alias("l"))
    told = lambda x: F.struct(F.col(at).alias("t"), x["id"].alias("id"), x["o"].alias("o"))
    seconds = per.select(*keys, at, told(F.element_at("l", -1)).alias("b1"), F.when(F.size("l") > 1, told(F.element_at("l", -2))).alias("b2"))
    b = F.floor(F.col(at) / within)
    seconds = seconds.withColumn("_b", F.explode(F.array(b, b + 1)))
    by = Window.partitionBy(*keys, "_b").orderBy(at)
    last = F.lag("b1").over(by)
    other_kind = F.coalesce("b2", F.when(last["o"] != F.col("b1.o"), last))
    seconds = seconds.withColumn("_alt", other_kind).withColumn("alt", F.last("_alt", True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    before = seconds.withColumns({"p1": F.lag("b1").over(by), "p2": F.lag("alt").over(by)}).filter(F.col("_b") == b).select(*keys, at, "p1", "p2")
    asked = rows.select(id_, at, *keys, other).join(before, [*keys, at])
    parent = F.when(F.col("p1.o") != F.col(other), F.col("p1")).otherwise(F.col("p2"))
    return asked.withColumn("_p", parent).filter(F.col(at) - F.col("_p.t") <= within).select(id_, F.col("_p.id").alias("parent"))


def cell(lat: Column, lon: Column, degrees: float) -> Column:
    return F.struct(F.floor(lat / degrees).alias("y"), F.floor(lon / degrees).alias("x"))


def near(left: DataFrame, right: DataFrame, most_km: float, suffix: str = "_r", keys: list[str] = [], at: str | None = None, back: float = 0, ahead: float = 0) -> DataFrame:
    """Pairs of (lat, lon) rows within a distance, found in the cells around, no cross join; with `keys`, of rows with equal
    keys, and with `at`, of rows whose right time is in [left time - back, left time + ahead].

    Cells are bands of latitude as high as the distance, each cut around the globe into as many cells as keep the distance's
    width at the band's far side (one near the poles), so a row's pairs are in three cells of three bands, over the date
    line and the poles too. Rows without a place pair with nothing.

    Both sides are sorted: files of places are so small for their rows that Spark would otherwise send whole tables through
    the driver to every task."""
    step = most_km / 110.57

    def turns(y: Column) -> Column:
        edge = F.least(F.lit(90.0), (F.greatest(F.abs(y), F.abs(y + 1)) + 1) * step)
        return F.greatest(F.lit(1), F.floor(F.cos(F.radians(edge)) * (0.99 * 360 / step)).cast("int"))

    x = lambda lon, y: F.floor(F.pmod(lon + 180, F.lit(360.0)) * turns(y) / 360).cast("int")
    r = right.select(*(F.col(c).alias(c + suffix) for c in right.columns)).withColumn("_y", F.floor(F.col("lat" + suffix) / step))
    r = r.withColumn("_x", x(F.col("lon" + suffix), F.col("_y")))
    l_ = left.withColumn("_y", F.explode(F.sequence(F.floor(F.col("lat") / step) - 1, F.floor(F.col("lat") / step) + 1)))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(x(F.col("lon"), F.col("_y")) + k, turns(F.col("_y")))))
    l_ = l_.withColumn("_x", F.explode(around))
    on = ["_y", "_x", *(f"_k{i}" for i in range(len(keys)))]
    r, l_ = (x.withColumns({f"_k{i}": F.col(k + end) for i, k in enumerate(keys)}) for x, end in ((r, suffix), (l_, "")))
    if at:
        size, then = max(1, back + ahead), F.col(at + (suffix or ""))
        r = r.withColumn("_b", F.floor(then / size))
        l_ = l_.withColumn("_b", F.explode(F.sequence(F.floor((F.col(at) - back) / size), F.floor((F.col(at) + ahead) / size))))
        on.append("_b")
    away = km(F.col("lat"), F.col("lon"), F.col("lat" + suffix), F.col("lon" + suffix))
    in_time = then.between(F.col(at) - back, F.col(at) + ahead) if at else F.lit(True)
    return l_.join(r.hint("merge"), on).filter(in_time).drop(*on).withColumn("km", away).filter(F.col("km") <= most_km)


def at_once(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """One row for all that are equal in `by`, with the least key and their number n; rows with a null there stay apart."""
    apart = F.when(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in by)), F.col(key))
    return rows.groupBy(*by, apart.alias("_apart")).agg(F.min(key).alias(key), F.count("*").alias("n")).drop("_apart")


def near_pairs(rows: DataFrame, key: str, keys: list[str], at: str, most_km: float, within: float, suffix: str = "_r") -> DataFrame:
    """(key, key_r): all pairs of rows with equal `keys`, an `at` that is `within` apart at most and a place within the distance,
    once each; key_r is the one that is first by (at, key). A row that lacks one of the columns pairs with nothing, rows of one
    key do not pair; repeated rows pair each.

    Rows equal in all of these meet the others once, and are told apart afterwards, so what is read to find a pair does not
    grow with copies; the pairs do."""
    by = [*keys, at, "lat", "lon"]
    one = cut(rows.select(*by).dropna().distinct())
    # Some thousandths more are read than are asked for, as sums of fractions are rounded.
    both = near(one, one, most_km, suffix, keys=keys, at=at, back=within * 1.001).filter(F.col(at) - F.col(at + suffix) <= within).drop("km")
    own = rows.select(key, *by)
    told = both.join(own.hint("merge"), by).select(key, at, *(c + suffix for c in by))
    told = told.join(own.toDF(*(c + suffix for c in own.columns)).hint("merge"), [c + suffix for c in by])
    first = (F.col(at + suffix) < F.col(at)) | (F.col(key + suffix) < F.col(key))
    return told.filter(first & (F.col(key) != F.col(key + suffix))).select(key, key + suffix)


def nearest(left: DataFrame, right: DataFrame, key: str, most_km: float, name: str) -> DataFrame:
    """left rows with the name of the nearest right row within a distance, and how far; null if none is. Every place is asked
    for once, and answers once, with the least name there."""
    asked, known = left.select("lat", "lon").distinct(), right.groupBy("lat", "lon").agg(F.min(name).alias(name))
    best = near(asked, known, most_km).groupBy("lat", "lon").agg(F.min(F.struct(F.round("km", 6).alias("km"), F.col(name + "_r").alias(name))).alias("best"))
    return left.join(best, ["lat", "lon"], "left").select(*left.columns, F.col(f"best.{name}").alias(name), F.col("best.km").alias("km"))


def first_near(rows: DataFrame, key: str, keys: list[str], at: str, other: str, most_km: float, back: int, ahead: int) -> DataFrame:
    """(key, first): of each row the first one, by time and key, with equal `keys` and a different `other` within a distance, at
    most `back` seconds before and `ahead` seconds after it. Rows without one are left out.

    Rows that are equal but for their key ask and answer once. The window is gone through in stretches, each four times as long
    as the one before; who has found one asks no more, so a row meets few others, however many its window holds. The first
    stretch is as long as two rows take, on average, in a square of the distance's size."""
    by = [*keys, other, at, "lat", "lon"]
    one = cut(rows.groupBy(*by).agg(F.min(key).alias(key)))
    step = most_km / 110.57
    square = one.groupBy(*keys, F.floor(F.col("lat") / step), F.floor(F.col("lon") / step), F.floor(F.col(at) / 86_400)).agg(F.count("*").alias("n"))
    mates = square.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0
    asking, found, start, width = one, [], -back, max(1, int(2 * 86_400 / mates))
    while start <= ahead:
        end = min(ahead, start + width - 1)
        both = near(asking, one, most_km, keys=keys, at=at, back=-start, ahead=end).filter(F.col(other) != F.col(other + "_r"))
        found.append(cut(both.groupBy(*by).agg(F.min(F.struct(at + "_r", key + "_r")).alias("_f"))))
        start, width, asking = end + 1, width * 4, cut(asking.join(found[-1], by, "left_anti"))
        if asking.isEmpty():
            break
    best = rows.join(reduce(DataFrame.unionByName, found), by).groupBy(key).agg(F.min("_f").alias("_f"))
    return best.select(key, F.col(f"_f.{key}_r").alias("first"))


def dictionary_matches(texts: DataFrame, key: str, words: Column, dictionary: DataFrame, alias: str) -> DataFrame:
    """(key, at, n, and the dictionary's columns) of aliases found as word runs, as many words as the longest alias has; a run inside a longer
    match is dropped.

    Every word becomes one row with those that follow it, and meets the aliases that begin with it; only hits go on to the
    window. Texts that are null or without words match nothing, nor do null aliases."""
    names = dictionary.filter(F.col(alias).isNotNull()).withColumns({"_first": F.split_part(alias, F.lit(" "), F.lit(1)), "n": F.size(F.split(alias, " "))})
    most = names.agg(F.max("n")).first()[0] or 1
    ahead = [f"_w{i}" for i in range(most)]
    own = texts.select(key, words.alias("_w0"))
    own = own.select("*", *(F.slice("_w0", i + 1, F.size("_w0")).alias(w) for i, w in enumerate(ahead) if i))
    runs = own.select(key, F.posexplode(F.arrays_zip(*ahead)).alias("at", "z")).select(key, "at", *(F.col(f"z.{w}") for w in ahead))
    run = reduce(lambda other, n: F.when(F.col("n") == n, F.concat_ws(" ", *ahead[:n])).otherwise(other), range(2, most + 1), F.col("_w0"))
    hit = runs.join(names, (runs["_w0"] == names["_first"]) & (run == F.col(alias))).drop("_first", *ahead)
    order = Window.partitionBy(key).orderBy("at", F.desc("n"))
    reach = F.max(F.col("at") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return hit.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("at") + F.col("n") > F.col("_reach"))).drop("_reach")


def overlay(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge in which the second table's values go first, cell by cell; its nulls leave the first one's value. Keys
    are to be unique on either side (repeated ones multiply); rows with a null key stay apart, on both sides."""
    cells = [c for c in base.columns if c not in keys]
    o = over.select(*keys, *(F.col(c).alias(f"_{c}") for c in cells))
    return base.join(o, keys, "full_outer").select(*keys, *(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in cells))


def only_match(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """key, value where there is exactly one distinct value."""
    return pairs.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_m")).filter(F.col(value) == F.col("_m")).drop("_m")
