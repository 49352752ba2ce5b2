"""Line dedup by pairwise alignment: common blocks of lines stay in the earliest document only.

Lines (blank ones apart) are hashed.  What may go is a run of neighbouring lines with `least_words` words or more that an
earlier document has, too.  The shortest such runs from each line on and up to each line stand for all longer ones; their
hashes make a pair of each later document and the first document that has the run, or has it as often, so pairs are twice
as many as shared lines at most, however often a run occurs.  The lines that a pair shares are aligned with patience diff
(lines unique on both sides, longest increasing run of them, then the gaps between), and aligned runs with enough words are
deleted from the later document.  So are, next, runs that the pair has in another order or in gaps without unique lines;
each run of the earlier document takes one of the later away.  For documents in which no line repeats this deletes just what
an alignment with every earlier document would; of a passage that a document repeats, as many stay as no one earlier document
has, where alignments with several earlier documents, added up, could take more.

Defined results: order is by id, then by a hash of the text; rows with a null id or null or empty text stay as they are;
rows that repeat id and text are one document and are edited alike; lines are compared without blanks at their ends;
blank lines never match and end a block; a document of which nothing is left but blank lines has an empty text; other
columns pass through, and ones named like the added columns are replaced.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.scratch import Scratch

ADDED = ("n_lines", "n_removed", "clean_text")


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned indices (i, j) with a[i] == b[j], increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        at_a, at_b = _once(a, a0, a1), _once(b, b0, b1)
        both = sorted((i, at_b[x]) for x, i in at_a.items() if x in at_b)
        anchors = _increasing(both)
        if not anchors:
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(out)


def _once(x: list[int], lo: int, hi: int) -> dict[int, int]:
    """Where the values stand that occur once."""
    seen: dict[int, int] = {}
    for i in range(lo, hi):
        seen[x[i]] = -1 if x[i] in seen else i
    return {v: i for v, i in seen.items() if i >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that increases in the second number; the first number increases already."""
    tails: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        back.append(last[k - 1] if k else -1)
        tails[k : k + 1], last[k : k + 1] = [j], [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def removed_lines(shared: list[tuple[int, list[int], list[int]]], least_words: int) -> list[int]:
    """Lines of the later document to delete; shared: (words, places in the earlier, places in the later) of each common
    line."""
    a = sorted((p, k) for k, (_, early, _) in enumerate(shared) for p in early)
    b = sorted((p, k) for k, (_, _, late) in enumerate(shared) for p in late)
    out: list[int] = []
    used: set[int] = set()
    block: list[tuple[int, int]] = []
    words, previous = 0, (-2, -2)
    for i, j in [*patience([k for _, k in a], [k for _, k in b]), (-1, -1)]:
        here = (a[i][0], b[j][0]) if i >= 0 else (-9, -9)
        if here != (previous[0] + 1, previous[1] + 1):
            if words >= least_words:
                used |= {x for x, _ in block}
                out += [y for _, y in block]
            block, words = [], 0
        if i >= 0:
            block.append(here)
            words += shared[a[i][1]][0]
        previous = here
    gone = set(out)
    return out + _moved([x for x in a if x[0] not in used], [x for x in b if x[0] not in gone], [x[0] for x in shared], least_words)


def _moved(a: list[tuple[int, int]], b: list[tuple[int, int]], words: list[int], least_words: int) -> list[int]:
    """Places in b of runs that a has anywhere; (place, line) each. A run of a takes one of b."""
    starts: dict[tuple, list[int]] = {}
    for i, j in reversed(_runs_on(a, words, least_words)):
        starts.setdefault(tuple(k for _, k in a[i:j]), []).append(i)
    ends = dict(_runs_on(b, words, least_words))
    used: set[int] = set()
    out: list[int] = []
    j = 0
    while j < len(b):
        size = ends.get(j, j) - j
        places = starts.get(tuple(k for _, k in b[j : j + size]), []) if size else []
        # A start that is used in part is used up for good.
        while places and not used.isdisjoint(range(places[-1], places[-1] + size)):
            places.pop()
        if not places:
            j += 1
            continue
        i = places.pop()
        while i + size < len(a) and j + size < len(b) and i + size not in used and a[i + size] == (a[i][0] + size, b[j + size][1]) and b[j + size][0] == b[j][0] + size:
            size += 1
        used.update(range(i, i + size))
        out += [p for p, _ in b[j : j + size]]
        j += size
    return out


def _runs_on(lines: list[tuple[int, int]], words: list[int], least_words: int) -> list[tuple[int, int]]:
    """(from, to) of the shortest run of neighbouring lines (place, line) from each line on that has enough words."""
    out = []
    to = total = 0
    for i in range(len(lines)):
        if to <= i:
            to, total = i, 0
        while total < least_words and to < len(lines) and (to == i or lines[to][0] == lines[to - 1][0] + 1):
            total += words[lines[to][1]]
            to += 1
        if total >= least_words:
            out.append((i, to))
        total -= words[lines[i][1]]
    return out


def run_keys(held: list[tuple[int, int, list[int]]], least_words: int) -> list[tuple[int, int]]:
    """(hash, k) of the shortest runs from each line on and up to each line, the k-th with that hash; held: (hash, words,
    places) of each line."""
    lines = sorted((p, k) for k, (_, _, places) in enumerate(held) for p in places)
    words = [w for _, w, _ in held]
    back = [(-p, k) for p, k in reversed(lines)]
    runs = {*_runs_on(lines, words, least_words), *((len(lines) - j, len(lines) - i) for i, j in _runs_on(back, words, least_words))}
    seen: dict[int, int] = {}
    out = []
    for i, j in runs:
        h = [held[k][0] for _, k in lines[i:j]]
        key = h[0] if len(h) == 1 else int.from_bytes(blake2b(struct.pack(f"<{len(h)}q", *h), digest_size=8).digest(), "little", signed=True)
        seen[key] = seen.get(key, 0) + 1
        out.append((key, seen[key]))
    return out


def _run_keys(least_words: int):
    @F.pandas_udf("array<struct<key:long,k:int>>")
    def keys(held: pd.Series) -> pd.Series:
        return pd.Series([[{"key": key, "k": k} for key, k in run_keys([(int(x["h"]), int(x["words"]), [int(p) for p in x["places"]]) for x in doc], least_words)] for doc in held])

    return keys


def _removed(least_words: int):
    @F.pandas_udf("array<int>")
    def removed(shared: pd.Series) -> pd.Series:
        return pd.Series([removed_lines([(int(x["words"]), [int(p) for p in x["early"]], [int(p) for p in x["late"]]) for x in pair], least_words) for pair in shared])

    return removed


def dedup_lines(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 10) -> DataFrame:
    """docs with n_lines, n_removed and clean_text (the text without the blocks that an earlier document has)."""
    scratch = Scratch(spark, "line-dedup")
    names = [c for c in docs.columns if c not in ADDED]
    text = F.col(f"`{text_col}`")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).filter("id is not null and text <> ''")
    lines = (
        own.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("id", "th", "pos", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"))
        .filter("line <> ''")
        .select("id", "th", "pos", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(r"\S+")).alias("words"))
    )
    doc = F.struct("id", "th")
    shared = scratch.put(
        lines.groupBy("h").agg(F.min(doc).alias("first"), F.max(doc).alias("last"))
        .filter(F.col("first") != F.col("last")).select("h")
    )
    # Every document's shared lines, and where they stand.
    held = scratch.put(
        lines.join(shared, "h").repartition("id", "th")  # so that a very frequent line may be split in the join
        .groupBy("id", "th", "h").agg(F.array_sort(F.collect_set("pos")).alias("places"), F.max("words").alias("words"))
    )
    # Their runs, and who has them first. A run with a line that is not shared is not shared.
    runs = scratch.put(
        held.groupBy("id", "th").agg(F.collect_list(F.struct("h", "words", "places")).alias("held"))
        .select("id", "th", F.explode(_run_keys(least_words)("held")).alias("run")).select("id", "th", "run.key", "run.k")
    )
    firsts = scratch.put(
        runs.groupBy("key", "k").agg(F.min(doc).alias("first"), F.max(doc).alias("last")).filter(F.col("first") != F.col("last")).select("key", "k", "first")
    )
    pairs = scratch.put(
        runs.join(firsts, ["key", "k"]).filter(F.col("first") != doc)
        .select("id", "th", F.col("first.id").alias("early_id"), F.col("first.th").alias("early_th")).repartition("id", "th").distinct()
    )
    late = pairs.join(held.select("id", "th", "h", "words", F.col("places").alias("late")), ["id", "th"])
    early = held.select(F.col("id").alias("early_id"), F.col("th").alias("early_th"), "h", F.col("places").alias("early"))
    common = late.join(early, ["early_id", "early_th", "h"])
    aligned = common.groupBy("id", "th", "early_id", "early_th").agg(F.collect_list(F.struct("words", "early", "late")).alias("shared"))
    gone = (
        aligned.select("id", "th", F.explode(_removed(least_words)("shared")).alias("pos"))
        .groupBy("id", "th").agg(F.collect_set("pos").alias("gone"))
    )
    gone = scratch.put(gone)
    keyed = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_th"))
    # Deletions grow with the corpus: a merge join at every size, never a broadcast.
    joined = keyed.join(gone.withColumnsRenamed({"id": "_id", "th": "_th", "gone": "_gone"}).hint("merge"), ["_id", "_th"], "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    clean = F.when(F.col("_gone").isNull(), text).otherwise(F.when(kept.rlike(r"\S"), kept).otherwise(""))
    return joined.select(
        *(F.col(f"`{c}`") for c in names),
        F.coalesce(F.size(F.split(text, "\n")).cast("long"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("_gone").cast("long"), F.lit(0)).alias("n_removed"),
        clean.alias("clean_text"),
    )
