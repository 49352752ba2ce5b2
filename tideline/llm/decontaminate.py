"""Benchmark decontamination with an FM-index per training shard.

The benchmark's items give test phrases: every run of `window` words, or the whole item where it has fewer.  A shard is
the texts of one Arrow batch of a task.  Its words become symbols; words that no phrase has cannot be part of a match, so
each ends a segment, and segments too short for the shortest phrase hold no match.  An FM-index over the segments answers
all phrases by backward search through wavelet-tree ranks, sampled suffix positions locate the occurrences, and
overlapping ones merge into removal spans.  Nothing is shuffled: documents stay where they were read.

Phrases are broadcast in blocks of items of at most `block_words` words (a phrase takes
4 bytes a word and 16 for its items, a new word 8: some 60 MB for a million words); a larger benchmark takes one pass
over the documents for each block, the spans found so far travelling with the document.

Defined results: words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased; a null, empty
or wordless text has no words and no hits and stays as it is; items without words (or null) match nothing; an item of
fewer words than the window is one phrase; repeated rows are judged alike; a repeated item id counts once; a null item id
hits but is not named; other columns pass through, and ones named like the added columns are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.fm_index import FMIndex
from tideline.llm.scan import WORDLIKE, grams, scan
from tideline.llm.scratch import small_batches

#: Words of the benchmark that one broadcast holds.
BLOCK_WORDS = 1_000_000
#: Bytes of texts that one index covers.
SHARD = 1 << 24
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.IntegerType())),
    T.StructField("clean_text", T.StringType()),
])


class Phrases:
    """Distinct phrases of some items: word symbols by length, and the items that have each phrase."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int):
        self.names = [item for item, _ in rows]
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, w in scan(pa.array([t for _, t in rows], pa.large_string()), WORDLIKE):
            hashes.append(w.hashes[w.first[0] : w.first[-1]])
            counts.append(np.diff(w.first))
        words, size = np.concatenate(hashes), np.concatenate(counts)
        first = np.cumsum(size) - size
        self.vocabulary = np.unique(words)
        symbols = (np.searchsorted(self.vocabulary, words) + 1).astype(np.int32)
        #: Of each length: the phrases' symbols, where the items of each begin and end, and the items.
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        length = np.minimum(size, window)
        for k in np.unique(length[length > 0]).tolist():
            items = np.flatnonzero(length == k)
            many = size[items] - k + 1
            item = np.repeat(items, many)
            at = np.arange(many.sum()) + np.repeat(first[items] - (np.cumsum(many) - many), many)
            _, index, phrase = np.unique(grams(words, k)[at], return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([phrase, item], 1), axis=0)
            offsets = np.searchsorted(pairs[:, 0], np.arange(len(index) + 1))
            self.by_length.append((k, symbols[at[index][:, None] + np.arange(k)], offsets, pairs[:, 1].astype(np.int32)))
        self.shortest = min((k for k, _, _, _ in self.by_length), default=0)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words of the shard are inside an occurrence, and the items found by document."""
        marks = np.zeros(len(hashes) + 1, np.int64)
        items: dict[int, set[str]] = {}
        if not self.shortest or not len(hashes):
            return marks[:-1] > 0, items
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        symbol = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        run = np.r_[0, symbol > 0, 0].astype(np.int8)
        cut = np.zeros(len(hashes) + 1, bool)
        cut[first] = True
        starts = np.flatnonzero((run[1:-1] == 1) & ((run[:-2] == 0) | cut[:-1]))
        ends = np.flatnonzero((run[1:-1] == 1) & ((run[2:] == 0) | cut[1:])) + 1
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return marks[:-1] > 0, items
        size = ends - starts + 1  # with the separator after each
        word = np.arange(size.sum()) + np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size)
        seq = np.r_[symbol, 0][word]
        seq[np.cumsum(size) - 1] = 0
        index = FMIndex(seq, len(self.vocabulary))
        for k, patterns, offsets, holders in self.by_length:
            lo, hi = index.search(patterns)
            many = hi - lo
            phrase = np.repeat(np.arange(len(patterns)), many)
            if not len(phrase):
                continue
            rows = np.arange(len(phrase)) + np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many)
            places = word[index.locate(rows)]
            np.add.at(marks, places, 1)
            np.add.at(marks, places + k, -1)
            doc = np.searchsorted(first, places, "right") - 1
            for d, p in np.unique(np.stack([doc, phrase], 1), axis=0).tolist():
                found = (self.names[x] for x in holders[offsets[p] : offsets[p + 1]])
                items.setdefault(d, set()).update(x for x in found if x is not None)
        return np.cumsum(marks[:-1]) > 0, items


def _runs(inside: np.ndarray, a: int, b: int) -> list[int]:
    """Start and end, one after the other, of the runs of true entries of inside[a:b], counted from a."""
    edge = np.flatnonzero(np.diff(np.r_[False, inside[a:b], False].astype(np.int8)))
    return edge.tolist()


def _pass(phrases, text_at: int, held_at: int):
    """One pass of one block of phrases; held_at: the column of the struct of what is found so far."""

    def rows(batches):
        own = phrases.value
        for batch in batches:
            m, text, held = batch.num_rows, batch.column(text_at), batch.column(held_at)
            words, hit_words, names, spans, clean = np.zeros(m, np.int64), np.zeros(m, np.int64), [None] * m, [None] * m, [None] * m
            earlier_items, earlier_spans = held.field("items"), held.field("spans")
            for i, w in scan(text, WORDLIKE, SHARD):
                inside, items = own.hits(w.hashes, w.first)
                first = w.first.tolist()
                words[i : i + len(first) - 1] = np.diff(w.first)
                total = np.r_[0, np.cumsum(inside)]
                dirty = set(np.flatnonzero(np.diff(total[w.first])).tolist())
                for j in range(len(first) - 1):
                    before = earlier_spans[i + j].as_py() or []
                    if not (j in dirty or before):
                        continue
                    a, b = first[j], first[j + 1]
                    hit = inside[a:b].copy()
                    for s, e in zip(before[::2], before[1::2]):
                        hit[s:e] = True
                    runs = _runs(hit, 0, b - a)
                    hit_words[i + j] = int(hit.sum())
                    spans[i + j] = runs
                    names[i + j] = sorted(items.get(j, set()) | set(earlier_items[i + j].as_py() or []))
                    kept, at, base = [], w.offsets[j], w.offsets[j + 1]
                    for s, e in zip(runs[::2], runs[1::2]):
                        kept.append(w.data[at : w.starts[a + s]].tobytes())
                        at = w.ends[a + e - 1]
                    kept.append(w.data[at:base].tobytes())
                    clean[i + j] = b"".join(kept).decode()
            added = pa.StructArray.from_arrays(
                [pa.array(words), pa.array(hit_words), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32())), pa.array(clean, pa.string())],
                names=list(ADDED.names),
            )
            columns = [added if k == held_at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """Items in groups of at most about block_words words, one group at a time on the driver."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / 2 / block_words))  # a word and the blank after it take two characters at least
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()]


def decontaminate(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = 10, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """docs with n_words, n_hit, items (ids of the items met, as sorted strings), spans (word numbers: start, end, start,
    end, ...) and clean_text (the text without the spans)."""
    small_batches(spark)
    names = [c for c in docs.columns if c not in ADDED.names]
    out = docs.select(*names).withColumn("_found", F.lit(None).cast(ADDED))
    schema = out.schema
    text_at, held_at = names.index(text_col), len(names)
    for rows in _blocks(benchmark, item_col, item_text, block_words):
        phrases = spark.sparkContext.broadcast(Phrases(rows, window))
        out = out.mapInArrow(_pass(phrases, text_at, held_at), schema)
    found = F.col("_found")
    return out.select(
        *(F.col(f"`{c}`") for c in names), found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"),
        F.coalesce(found["items"], F.array().cast("array<string>")).alias("items"),
        F.coalesce(found["spans"], F.array().cast("array<int>")).alias("spans"),
        F.coalesce(found["clean_text"], F.col(f"`{text_col}`")).alias("clean_text"),
    )
