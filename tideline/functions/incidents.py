"""Incidents read off headlines, in column expressions: a consuming scanner and what it is used for.

A scanner is an ordered list of patterns. Each reads what the ones before have left: its matches go into its list and out of
the text, so a figure counted once is not counted again by a later pattern. Headlines are put into plain form first (lower
case, number words as digits, hedges out, verbs of killing and wounding as one word each), so patterns stay short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words (fixed values).
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
PEOPLE = "civilian|citizen|child|boy|girl|woman|man|farmer|fisherman|soldier|fighter|teacher|doctor|journalist|officer|driver|shepherd"
CAUSES = (("mine", r"\b(?:sea |naval )?mines?\b"), ("projectile", r"\b(?:projectile|missile|drone|rocket)s?\b"), ("boat", r"\b(?:small boat|small craft|gunfire|gunmen|armed men)\b"), ("seizure", r"\b(?:seiz|board|hijack|detain)\w*\b"))
KINDS = (("tanker", r"\btanker\b"), ("carrier", r"\b(?:bulk )?carrier\b"), ("ship", r"\b(?:ship|vessel|boat)\b"))


def plain(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\w.]+", " ")
    digits = F.create_map(*(F.lit(x) for n, word in enumerate(NUMBERS, 1) for x in (word, str(n))))
    t = F.array_join(F.transform(F.split(t, r"\b"), lambda w: F.coalesce(F.element_at(digits, w), w)), "")
    t = F.regexp_replace(t, r"\b(?:at least|more than|over|about|around|some|nearly|almost|up to|no fewer than) (?=\d)", "")
    t = F.regexp_replace(t, r"\b(?:kill(?:s|ed|ing)?|dead|died|deaths?)\b", "KILL")
    return F.regexp_replace(t, r"\b(?:wound(?:s|ed|ing)?|injur(?:es|ed|ing|ies|y)|hurts?)\b", "HURT")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def consume(text: Column, patterns: list[tuple[str, str, int | None]]) -> Column:
    """A struct of lists of numbers: of every pattern (list, pattern, value) the matches go to the list, as the number in
    its first group or as the value given, and out of the text. Lists keep the order of patterns, then of the text.

    What a pattern leaves is bound to a name (once), so that each pattern is read once a text and not once for every later one."""

    def hits(left: Column, pattern: str, value: int | None) -> Column:
        if value is None:
            return F.transform(F.regexp_extract_all(left, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
        return F.array_repeat(F.lit(value), F.size(F.regexp_extract_all(left, F.lit(pattern), F.lit(0))))

    def read(left: Column, n: int, found: dict[str, list[Column]]) -> Column:
        if n == len(patterns):
            return F.struct(*(F.array_distinct(F.filter(F.concat(*lists), lambda n: n > 0)).alias(name) for name, lists in found.items()))
        name, pattern, value = patterns[n]
        return once(left, lambda t: read(F.regexp_replace(t, pattern, " "), n + 1, found | {name: [*found.get(name, []), hits(t, pattern, value)]}))

    return read(text, 0, {})


_N = r"\b(\d{1,4})\b"
#: Totals first: they count the dead and the hurt together and are no count of either.
TOLL = [
    ("total", rf"KILL (?:and|or) HURT {_N}", None), ("total", rf"{_N} (?:(?!KILL|HURT|none\b|not?\b|\d)\w+ ){{0,2}}KILL (?:and|or) HURT", None), ("total", rf"(?:KILL and HURT|casualty) toll (?:rises )?(?:to|of|at) {_N}", None),
    ("dead", rf"{_N} (?:(?!KILL|HURT|none\b|not?\b|\d)\w+ ){{0,3}}KILL", None), ("dead", rf"KILL {_N}", None), ("dead", rf"KILL (?:an? )?(?:(?!KILL|HURT|none\b|not?\b|\d)\w+ )?(?:{PEOPLE})\b", 1), ("dead", rf"\b(?:{PEOPLE}) (?:was )?KILL", 1),
    ("hurt", rf"{_N} (?:(?!KILL|HURT|none\b|not?\b|\d)\w+ ){{0,3}}HURT", None), ("hurt", rf"HURT {_N}", None), ("hurt", rf"HURT (?:an? )?(?:(?!KILL|HURT|none\b|not?\b|\d)\w+ )?(?:{PEOPLE})\b", 1),
]


def toll_of(c: Column) -> Column:
    """{total, dead, hurt}: the figures that a headline counts, each once; null texts count nothing."""
    return consume(plain(c), TOLL)


def victims(c: Column) -> Column:
    """Who died: fighters, soldiers or civilians, by the first of these that is named; null if none is."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(r"\b(?:fighters?|militants?|gunmen)\b"), "fighters").when(t.rlike(r"\b(?:soldiers?|troops|servicemen)\b"), "soldiers").when(t.rlike(r"\b(?:civilians?|child(?:ren)?|wom[ae]n|residents?|citizens?|family|farmers?|fishermen)\b"), "civilians")


def ship_incident(c: Column, seas: list[tuple[str, str]]) -> Column:
    """{kind, sea, name, cause} of an attack on one ship; null if a headline tells none, tells several, or says neither the
    sea nor a name nor a cause. seas: (name, pattern), the first that fits counts."""
    first = lambda low, table: F.coalesce(*(F.when(low.rlike(p), k) for k, p in table))
    ship = r"\b(?:MT|MV|M/T|M/V) ?([A-Z0-9][\w-]*(?: [A-Z0-9][\w-]*){0,2})"

    def of(x: Column) -> Column:
        told = x["attack"] & x["kind"].isNotNull() & F.coalesce(x["sea"], x["name"], x["cause"]).isNotNull()
        return F.when(told, F.struct(*(x[f].alias(f) for f in ("kind", "sea", "name", "cause"))))

    def read(x: Column) -> Column:
        low, name = x["low"], F.nullif(F.lower(F.regexp_replace(F.regexp_extract(x["t"], ship, 1), "[^A-Za-z0-9]", "")), F.lit(""))
        attack = low.rlike(r"\b(?:attack|hit|struck|explo|sunk|sank|seiz|board|hijack|damag|mine)\w*")
        return once(F.struct(attack.alias("attack"), first(low, KINDS).alias("kind"), first(low, seas).alias("sea"), name.alias("name"), first(low, CAUSES).alias("cause")), of)

    t = F.coalesce(c, F.lit(""))
    return once(F.struct(t.alias("t"), F.lower(t).alias("low")), read)


def money_key(c: Column, countries: list[str]) -> Column:
    """"country amount unit" of the first sum of dollars, with the first country that the text names; null without either."""
    t = F.coalesce(c, F.lit(""))
    amount = r"(?i)(?:\$|\busd ?)(\d+(?:\.\d+)?) ?(billion|bn|million|mn|trillion)\b"
    n, unit = F.nullif(F.regexp_extract(t, amount, 1), F.lit("")), F.lower(F.regexp_extract(t, amount, 2))
    unit = F.when(unit == "bn", "billion").when(unit == "mn", "million").otherwise(unit)
    land = F.nullif(F.lower(F.regexp_extract(t, r"\b(" + "|".join(countries) + r")\b", 1)), F.lit(""))
    return F.when(n.isNotNull() & land.isNotNull(), F.concat_ws(" ", land, n, unit))
