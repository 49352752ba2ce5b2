"""Runs of words that repeat with a period, by enumeration of maximal pairs.

A maximal pair of a text are two places i < j from which the same words follow, as many as possible (right-maximal), with
different words before them (left-maximal).  If a pair's distance q = j - i is short against the words in common, the pair
is a run: the words from i to the end of the second copy have period q, and neither side extends it.  So runs are found
without extending anything: by the pairs of distance q and common length m with m >= (exponent - 1) * q.

Pairs come from the tree of LCP intervals of the text's suffix array, bottom-up: an interval of common length m holds the
places below it in text order, each with the class of its left word; of two intervals that meet, the places of the smaller
are looked up among those of the larger, and two places of different classes are a maximal pair of length m.  Places of an
interval that are nearer than m / 3 stand at equal distances (they are copies inside one run), so only the nearest place to
either side of each needs to be looked at; pairs further apart than the shortest period would give multiples of it.
Intervals shorter than the shortest common length of a run are never built: suffixes whose first words stand nowhere else
in the text are left out before sorting.

A text takes O(n log n) steps and memory for log n ranks of its n words; nothing passes between texts.

Defined results: words are runs of bytes other than blank and tab to carriage return; null, empty and blank texts have no
words, no runs and an empty collapsed text; a stretch has one run, that of its smallest period; runs may overlap; rows that
repeat are read one by one; other columns pass through, those named like the added ones are replaced; an empty table gives
no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.scratch import small_batches

ADDED = ("n_words", "runs", "collapsed_text")
_RUN = T.StructType([T.StructField(k, T.LongType(), False) for k in ("start", "length", "period")])
_MULTIPLIERS = np.random.default_rng(13).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class Places:
    """Places in text order, in chunks, so that one more costs no more than a chunk's length."""

    MOST = 1024

    def __init__(self, first: int):
        self.chunks, self.firsts, self.n = [[first]], [first], 1

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The nearest places before and after one that is not among them."""
        c = max(bisect_right(self.firsts, x) - 1, 0)
        chunk = self.chunks[c]
        k = bisect_left(chunk, x)
        before = chunk[k - 1] if k else None
        after = chunk[k] if k < len(chunk) else self.firsts[c + 1] if c + 1 < len(self.firsts) else None
        return before, after

    def add(self, x: int) -> None:
        c = max(bisect_right(self.firsts, x) - 1, 0)
        chunk = self.chunks[c]
        chunk.insert(bisect_left(chunk, x), x)
        self.firsts[c], self.n = chunk[0], self.n + 1
        if len(chunk) > self.MOST:
            half = len(chunk) // 2
            self.chunks[c : c + 1] = [chunk[:half], chunk[half:]]
            self.firsts[c : c + 1] = [chunk[0], chunk[half]]

    def __iter__(self):
        for chunk in self.chunks:
            yield from chunk


def repeated(ids: np.ndarray, n: int) -> np.ndarray:
    """Places whose next n words may stand at another place, too: none that do is missing (equal hashes)."""
    m = len(ids) - n + 1
    if m < 2:
        return np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h += (ids[k : k + m].astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[k % 64]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    return np.sort(order[np.append(same, False) | np.append(False, same)])


def _ranks(ids: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: rank of the 2 ** k words from i, with an end of text below every word; until all ranks differ."""
    n, out = len(ids), [ids.astype(np.int64)]
    while (1 << (len(out) - 1)) < n and (len(out) == 1 or out[-1].max() < n - 1):
        r, step = out[-1], 1 << (len(out) - 1)
        follow = np.zeros(n, np.int64)
        follow[: n - step] = r[step:] + 1
        code = r * (int(r.max()) + 2) + follow
        out.append(np.unique(code, return_inverse=True)[1])
    return out


def _common(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that follow alike from i and from j."""
    n, out = len(ranks[0]), np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = i + out, j + out
        fits = np.maximum(a, b) + (1 << k) <= n
        same = fits.copy()
        same[fits] = ranks[k][a[fits]] == ranks[k][b[fits]]
        out += same.astype(np.int64) << k
    return out


def maximal_pairs(ids: np.ndarray, shortest: int, times: int):
    """(i, distance, common length) of maximal pairs with a common length of at least shortest and times the distance:
    all with the smallest period of their stretch, and perhaps some with a multiple."""
    at = repeated(ids, shortest)
    if len(at) < 2:
        return
    ranks = _ranks(ids)
    order = at[np.argsort(ranks[-1][at], kind="stable")]
    common = _common(ranks, order[:-1], order[1:])
    left = np.append(-1, ids[:-1])[: len(ids)].tolist()
    stack: list = [(0, None)]

    def meet(a, b, m: int):
        """The places of both intervals; pairs are of the first words in which they differ, after m in common."""
        small, large = (a, b) if a.n < b.n else (b, a)
        for x in small:
            for y in large.around(x):
                if y is not None and left[x] != left[y] and abs(x - y) * times <= m:
                    found.append((min(x, y), abs(x - y), m))
        for x in small:
            large.add(x)
        return large

    found: list[tuple[int, int, int]] = []
    for i, h in zip(order.tolist(), [*common.tolist(), 0]):
        node, h = Places(i), h if h >= shortest else 0
        while stack[-1][0] > h:
            m, other = stack.pop()
            node = meet(other, node, m)
        if stack[-1][0] == h:
            if h:
                stack[-1] = (h, meet(stack[-1][1], node, h))
        else:
            stack.append((h, node))
        if len(found) > 1024:
            yield from found
            found.clear()
    yield from found


def runs_of(ids: np.ndarray, least_length: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start and period: stretches of smallest period q that neither
    side extends, of at least least_length and exponent * q words."""
    best: dict[tuple[int, int], int] = {}
    # With period 1 a run has least_length - 1 words in common, with period q at least (exponent - 1) * q.
    shortest = min(max(least_length - q, (exponent - 1) * q, 1) for q in range(1, max(least_length, 2)))
    for i, q, m in maximal_pairs(ids, shortest, exponent - 1):
        if m + q >= least_length:
            at = (i, m + q)
            best[at] = min(q, best.get(at, q))
    return sorted((i, n, q) for (i, n), q in best.items())


def kept_words(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers of words, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def detect_runs(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", least_length: int = 6, exponent: int = 4) -> DataFrame:
    """docs with n_words, runs (start, length, period; by start, then period) and collapsed_text: the words that no run
    contains after its first period, joined by one space."""
    small_batches(spark)
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED))
    at = kept.columns.index(text_col)
    kind = pa.list_(pa.struct([pa.field(k, pa.int64(), False) for k in ("start", "length", "period")]))

    def rows(batches):
        for batch in batches:
            counts, found, texts = [], [], []
            for raw in batch.column(at).cast(pa.binary()).to_pylist():
                words = (raw or b"").split()
                runs = runs_of(word_ids(words), least_length, exponent) if len(words) >= least_length else []
                if runs:
                    words_left = [w for w, stays in zip(words, kept_words(len(words), runs).tolist()) if stays]
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(b" ".join(words_left if runs else words).decode())
            added = [pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *ADDED])

    more = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN, False)), T.StructField("collapsed_text", T.StringType())]
    return kept.mapInArrow(rows, T.StructType([*kept.schema, *more]))


_WORD = r"[^\x20\x09-\x0D]+"


def with_planted_runs(id_col: Column, text: Column) -> Column:
    """The text of which a tenth of the documents gets a periodic tail: with h = crc32 of the id, n words, g = h div 10,
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8), word i >= a becomes word a + (i - a) mod p where h mod 10 is 0."""
    h = F.crc32(id_col.cast("string"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda k: F.element_at(w, (a + k % p + 1).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    edited = F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))), planted), 1)
    return F.when((h % 10 == 0) & text.rlike(_WORD), edited).otherwise(text)
