"""Merging folds: copies join the first earlier home that they fit, and the home changes with every copy that joins.

A home is not a row but what its copies have made of it: blanks are filled from each copy, outlets are listed, a source
nearer the story takes the lead, and the next copy is compared with the home as it is then.  So pairs of rows decide
nothing; cards are folded in time order within their group (operators/ordered_fold.py), with the group's open homes as the
state: those that are at most `within` seconds older than the card.  A group's state empties wherever nothing happens for
that long, so blocks of a busy group soon agree on it.

Cards have: id, t (seconds), and of an incident kind, sea, name, cause (null or empty: not told), source, rank (how near to
the story the source is).  Two incidents are the same by name if both have one.  Without names they need seas that meet
(equal, or neighbours by the table given), and nothing that tells them apart: different causes, or different kinds unless
one is the general kind.  If a sea is not told, the kind, not the general one, and the cause must both be told and equal.

Defined results: a null time counts as 0; cards without any of sea, name and cause are homes that nothing joins; equal
times go by id; an id that repeats is a card of its own each time; the outlets listed are different ones, in the order they
came, the lead's own left out, `most_also` of them at most (a feature of the list: joining goes on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.lineage import cut
from tideline.operators.ordered_fold import Step, fold_in_order

_FACTS = ("kind", "sea", "name", "cause")
MERGED = "home long, joined boolean, lead string, also array<string>, kind_now string, sea_now string, name_now string, cause_now string"


def _told(x: dict, y: dict, fact: str) -> bool | None:
    """Whether a fact is equal; None if one does not tell it."""
    return x[fact] == y[fact] if x[fact] and y[fact] else None


def same_incident(x: dict, y: dict, neighbours: frozenset[tuple[str, str]], general: str) -> bool:
    name, sea, cause, kind = (_told(x, y, f) for f in ("name", "sea", "cause", "kind"))
    if name is not None:
        return name
    if sea is None:
        return bool(kind and cause) and x["kind"] != general
    meets = sea or (x["sea"], y["sea"]) in neighbours or (y["sea"], x["sea"]) in neighbours
    return meets and cause is not False and (kind is not False or general in (x["kind"], y["kind"]))


def merging(within: int, neighbours: frozenset[tuple[str, str]], general: str, most_also: int) -> Step:
    def step(state, row):
        t = row["t"] or 0
        card = {f: row[f] or "" for f in _FACTS} | {"id": row["id"], "t": t, "source": row["source"], "rank": row["rank"] or 0, "also": []}
        homes = [h for h in state or [] if t - h["t"] <= within]
        told = card["sea"] or card["name"] or card["cause"]
        at = next((k for k, h in enumerate(homes) if told and same_incident(h, card, neighbours, general)), None)
        if at is None:
            home = card
            homes = [*homes, home] if told else homes
        else:
            home = dict(homes[at])
            homes = [*homes[:at], home, *homes[at + 1 :]]
            for f in _FACTS:
                home[f] = home[f] or card[f]
            if home["kind"] == general and card["kind"]:
                home["kind"] = card["kind"]
            lead, other = home["source"], card["source"]
            if card["rank"] > home["rank"]:
                home["source"], home["rank"], lead, other = card["source"], card["rank"], other, lead
            listed = [s for s in [*home["also"], other] if s is not None and s != home["source"]]
            home["also"] = list(dict.fromkeys(listed))[:most_also]
        return homes, {"home": home["id"], "joined": at is not None, "lead": home["source"], "also": home["also"], **{f"{f}_now": home[f] or None for f in _FACTS}}

    return step


def merge_cards(cards: DataFrame, group: list[str], *, within: int, neighbours: frozenset[tuple[str, str]] = frozenset(), general: str = "ship", most_also: int = 12, block_rows: int = 50_000) -> DataFrame:
    """cards with the home each makes or joins, and the home as it is after that."""
    return fold_in_order(cards, group, ["t", "id"], merging(within, neighbours, general, most_also), MERGED, block_rows=block_rows).drop("_state")


# Pins

PINNED = "pin long, joined boolean, lead long, also array<string>, actor_now string, score_now int"


def pinning(km_one_day: float, km_one_link: float, seconds: int) -> Step:
    """Pins of one place name: a pin joins the first open one of its day within km_one_day, or of the day before with the same
    link within km_one_link; not if both are timed and further apart than `seconds`, nor if both name different actors."""
    from math import asin, cos, radians, sin, sqrt

    def away(a: dict, b: dict) -> float:
        x, y = sin(radians(b["lat"] - a["lat"]) / 2), sin(radians(b["lon"] - a["lon"]) / 2)
        return 2 * 6371.0 * asin(min(1.0, sqrt(x * x + cos(radians(a["lat"])) * cos(radians(b["lat"])) * y * y)))

    def fits(p: dict, q: dict) -> bool:
        if p["actor"] and q["actor"] and p["actor"] != q["actor"]:
            return False
        if p["t"] is not None and q["t"] is not None and abs(p["t"] - q["t"]) > seconds:
            return False
        d = away(p, q)
        return (p["day"] == q["day"] and d < km_one_day) or (p["day"] != q["day"] and p["link"] is not None and p["link"] == q["link"] and d < km_one_link)

    def step(state, row):
        own = {k: row[k] for k in ("id", "day", "t", "lat", "lon", "link", "source")} | {"actor": row["actor"] or "", "also": []}
        own["score"] = (4 if row["t"] is not None else 0) + (2 if own["actor"] else 0)
        own["pin"] = row["id"]
        if None in (row["day"], row["lat"], row["lon"]):
            return state, {"pin": row["id"], "joined": False, "lead": row["id"], "also": [], "actor_now": own["actor"] or None, "score_now": own["score"]}
        open_ = [p for p in state or [] if row["day"] - p["day"] <= 1]
        at = next((k for k, p in enumerate(open_) if fits(p, own)), None)
        if at is None:
            open_.append(own)
            now = own
        else:
            was = open_[at]
            keep, drop = (own, was) if own["score"] > was["score"] else (was, own)
            told = [s for s in [*was["also"], drop["source"]] if s is not None and s != keep["source"]]
            now = {**keep, "pin": was["pin"], "also": list(dict.fromkeys(told)), "actor": keep["actor"] or drop["actor"]}
            open_ = [*open_[:at], now, *open_[at + 1 :]]
        return open_, {"pin": now["pin"], "joined": at is not None, "lead": now["id"], "also": now["also"], "actor_now": now["actor"] or None, "score_now": now["score"]}

    return step


def merge_pins(pins: DataFrame, name: str, *, km_one_day: float = 15.0, km_one_link: float = 10.0, seconds: int = 3 * 3600, block_rows: int = 50_000) -> DataFrame:
    """pins (name, id, day as a number, t or null, lat, lon, link, source, actor) with the pin each makes or joins, and that pin
    as it is then: the row that leads it (timed rows and such that name an actor go before others), the other sources, the
    actor. Pins come by day and id; a pin without day or place stands for itself."""
    return fold_in_order(pins, [name], ["day", "id"], pinning(km_one_day, km_one_link, seconds), PINNED, block_rows=block_rows).drop("_state")


def first_pin(kind: str, within: int, most_km: float) -> Step:
    """Fixes go to the first open pin, the earliest that is at most `within` seconds older and as near; one that finds none opens
    one. Open pins stand apart from each other, so they are few, however many fixes there are."""
    from math import asin, cos, degrees, radians, sin, sqrt

    high = degrees(most_km / 6371.0) * 1.001

    def step(state, row):
        t, lat, lon = row["t"], row["lat"], row["lon"]
        own = {"t": t, "lat": lat, "lon": lon, "id": row["id"]}
        if None in (row[kind], t, lat, lon):
            return state, {"pin": own}
        open_ = [p for p in state or [] if t - p["t"] <= within]
        for p in open_:
            if abs(lat - p["lat"]) <= high:
                x, y = sin(radians(lat - p["lat"]) / 2), sin(radians(lon - p["lon"]) / 2)
                if 2 * 6371.0 * asin(min(1.0, sqrt(x * x + cos(radians(p["lat"])) * cos(radians(lat)) * y * y))) <= most_km:
                    return open_, {"pin": p}
        return [*open_, own], {"pin": own}

    return step


def first_pins(fixes: DataFrame, kind: str, *, within: int, most_km: float, block_rows: int = 100_000) -> DataFrame:
    """fixes (kind, id, t, lat, lon) with the pin (t, lat, lon, id) that each opens or goes to, by time and id: of a kind's fixes
    within `within` seconds and the distance of each other the first stays, and one that has gone to a pin takes none. A fix
    that lacks a column is a pin of its own and takes none. No pairs are made, and no table is sent through the driver."""
    return fold_in_order(fixes, [kind], ["t", "id"], first_pin(kind, within, most_km), "pin struct<t: long, lat: double, lon: double, id: long>", block_rows=block_rows).drop("_state")


def merge_groups(groups: DataFrame, other: DataFrame) -> DataFrame:
    """(id, term): of each group (rows id, term) its own terms and all terms of the groups of `other` that share one with it.
    Equi-joins on terms; null terms are none; a term counts once.

    Terms of one group of `other` can be met by one way only, so those rows, nearly all, are streamed out of the join and no
    task has to hold them; only terms of several groups, and of none, are made distinct."""
    own, more = groups.select("id", "term").filter("term is not null").distinct(), other.select("id", "term").filter("term is not null").distinct()
    more = cut(more.toDF("other", "term"))
    met = cut(own.join(more, "term").select("id", "other").distinct())
    in_ = more.groupBy("term").agg(F.count("*").alias("_n"))
    counted = more.join(in_, "term")
    told = lambda some: met.join(some.select("other", "term").hint("merge"), "other").select("id", "term")
    alone = own.join(in_, "term", "left_anti").select("id", "term")
    return told(counted.filter("_n = 1")).unionByName(told(counted.filter("_n > 1")).distinct()).unionByName(alone)
