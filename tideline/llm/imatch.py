"""Document fingerprints by I-Match: hashes of the terms in a band of inverse document frequency.

A term's idf is ln(documents / documents that have it).  Terms in the band make the lexicon; a document keeps its distinct
terms that are in it, in sorted order.  Its fingerprint is the hash of all of them and the hashes of several randomised
subsets: subset k holds each lexicon term with a chance of rates[k], by a hash of the term, so that a small change of a text
changes few of the hashes.  Two fingerprints are equal just when the kept terms are (but for 64-bit hashes).  The likeness
of two is the share of subsets, of those that hold a term of either, with equal hashes; where no subset holds any, it is 1 or
0 as the whole lists are equal or not.

Subsets are small, so that most of those that hold a term of a usual text hold one or two: measured on texts of about 400
words of which half was replaced (1,500 of sf0.1), 64 subsets of 1/32, 1/128, 1/256 and 1/512 give a mean likeness of 0.06,
0.20, 0.26 and 0.30 (against unrelated texts: 0.00 to 0.01), and leave 2, 11, 21 and 30 texts to the whole list. 1/256 is used.

The band's upper end bounds the lexicon: a term of idf at most `most_idf` is in exp(-most_idf) of all documents, so there
are no more such terms than exp(most_idf) times the mean number of distinct terms of a document, whatever the corpus
size.  The lexicon is broadcast, 16 bytes a term; one beyond `most_terms` (where documents have tens of thousands of
distinct terms each) is refused with an error, never thinned out.

Defined results: terms are runs of bytes other than blanks and tab to carriage return, A-Z lower-cased, told apart by
64-bit hashes; null and blank texts have no terms; a document without a term of the lexicon falls back on the hash of all
its distinct terms and is in no subset; equal texts have equal fingerprints; repeated rows are fingerprinted alike.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.scan import NOT_SPACE, U, mix, scan
from tideline.llm.scratch import Scratch, shuffle_partitions

#: Share of the lexicon that each subset holds.
RATES = (1 / 256,) * 64
_WHOLE, _EMPTY = 16, "-" * 8


@dataclass
class Lexicon:
    """Hashes of the terms of the band, sorted, and for each the subsets that hold it as bits."""

    terms: np.ndarray
    subsets: np.ndarray


def _document_frequency(batches):
    """Distinct terms of each text, counted over a task: (term, df)."""
    held: list[np.ndarray] = []
    size = 0

    def counted():
        t, c = np.unique(np.concatenate(held), return_counts=True)
        for a in range(0, len(t), 1 << 16):
            yield pa.record_batch([pa.array(t[a : a + (1 << 16)].view(np.int64)), pa.array(c[a : a + (1 << 16)])], ["term", "df"])

    for batch in batches:
        for _, w in scan(batch.column(0), NOT_SPACE):
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                if b > a:
                    held.append(np.unique(w.hashes[a:b]))
                    size += len(held[-1])
        if size > 1 << 22:
            yield from counted()
            held, size = [], 0
    if held:
        yield from counted()


def lexicon(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", least_idf: float = 1.5, most_idf: float = 7.0, most_terms: int = 16_000_000) -> Lexicon:
    """The terms of the band over all documents."""
    n, scratch = docs.count(), Scratch(spark, "imatch")
    df = docs.select(text_col).mapInArrow(_document_frequency, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    band = scratch.put(df.filter(F.col("df").between(max(2.0, n * math.exp(-most_idf)), n * math.exp(-least_idf))))
    if band.count() > most_terms:
        raise ValueError(f"the band holds more than {most_terms} terms: lower most_idf")
    terms = np.sort(band.select("term").toPandas()["term"].to_numpy(np.int64).view(np.uint64))
    scratch.drop(band)
    bits = np.zeros(len(terms), np.uint64)
    for k, rate in enumerate(RATES):
        inside = mix(terms ^ mix(np.array([k + 1], np.uint64))) < U(int(rate * (1 << 64)))
        bits |= inside.astype(np.uint64) << U(k)
    return Lexicon(terms, bits)


def fingerprint(terms: np.ndarray, own: Lexicon) -> str:
    """Of a text's word hashes: 16 characters for the whole list, eight for each subset."""
    distinct = np.unique(terms)
    if not len(distinct):
        return "-" * _WHOLE + _EMPTY * len(RATES)
    at = np.minimum(np.searchsorted(own.terms, distinct), max(len(own.terms) - 1, 0))
    known = own.terms[at] == distinct if len(own.terms) else np.zeros(len(distinct), bool)
    kept = distinct[known]
    if not len(kept):
        return xxhash.xxh64_hexdigest(b"all" + distinct.tobytes()) + _EMPTY * len(RATES)
    parts, bits = [_EMPTY] * len(RATES), own.subsets[at[known]]
    term, subset = np.nonzero((bits[:, None] >> np.arange(len(RATES), dtype=np.uint64)) & U(1))
    order = np.argsort(subset, kind="stable")  # the terms of a subset stay sorted
    term, subset = kept[term[order]], subset[order]
    used, first = np.unique(subset, return_index=True)
    for k, i, j in zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(term)]):
        parts[k] = xxhash.xxh32_hexdigest(term[i:j].tobytes())
    return xxhash.xxh64_hexdigest(kept.tobytes()) + "".join(parts)


def likeness(a: str, b: str) -> float:
    """Share of the subsets that hold a term of either text in which both hash alike; where none does, whether all is equal."""
    parts = [(a[i : i + 8], b[i : i + 8]) for i in range(_WHOLE, len(a), 8)]
    used = [x == y for x, y in parts if x != _EMPTY or y != _EMPTY]
    return sum(used) / len(used) if used else float(a == b)


def fingerprints_of(texts: pa.Array, own: Lexicon) -> list[str]:
    out: list[str] = []
    for _, w in scan(texts, NOT_SPACE):
        out += [fingerprint(w.hashes[a:b], own) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
    return out


def fingerprints(spark: SparkSession, docs: DataFrame, own: Lexicon, *, text_col: str = "text") -> DataFrame:
    """docs with a fingerprint column."""
    shared = spark.sparkContext.broadcast(own)
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"))
    at = kept.columns.index(text_col)

    def rows(batches):
        for batch in batches:
            out = pa.array(fingerprints_of(batch.column(at), shared.value), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "fingerprint"])

    return kept.mapInArrow(rows, T.StructType([*kept.schema, T.StructField("fingerprint", T.StringType())]))


_RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _judged(ids: list, texts: list[str], prints: list[str], nexts: list[str], next_prints: list[str], own: Lexicon) -> pa.RecordBatch:
    """Each text against its edited text (the last half replaced by the next text's beginning) and the next text."""
    edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts)]
    edited_prints = fingerprints_of(pa.array(edited, pa.large_string()), own)
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited]), pa.array(prints, pa.string()), pa.array(edited_prints, pa.string()),
        pa.array([likeness(a, b) for a, b in zip(prints, edited_prints)]), pa.array([likeness(a, b) for a, b in zip(prints, next_prints)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def with_next(spark: SparkSession, docs: DataFrame, own: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document, in descending id with the first after the last: its fingerprint against that of an edited text and of
    the next document. Rows of one id go by a hash of their text; a null id comes last.

    Documents are dealt out by range of id, so that neighbours meet in a task; the first and last text of every range (two
    rows a task) are matched up afterwards.
    """
    scratch, shared = Scratch(spark, "imatch"), spark.sparkContext.broadcast(own)
    order = [F.col("id").desc(), F.xxhash64("text")]
    dealt = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange(shuffle_partitions(spark), F.col("id").desc(), F.xxhash64("text")).sortWithinPartitions(*order)
    )

    def rows(batches):
        held, first, task = None, None, TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            if not ids:
                continue
            prints = fingerprints_of(batch.column("text"), shared.value)
            if held:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            first = first or (texts[0], prints[0])
            held = (ids[-1], texts[-1], prints[-1])
            if len(ids) > 1:
                done = _judged(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:], shared.value)
                nothing = pa.nulls(done.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([*done.columns, pa.nulls(done.num_rows, pa.int32()), nothing, nothing, nothing], names=[*_NAMES, "task", "text", "first_text", "first_print"])
        if held:
            row = {"id": held[0], "fingerprint": held[2], "task": task, "text": held[1], "first_text": first[0], "first_print": first[1]}
            types = dict(zip(_NAMES, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())))
            types |= {"task": pa.int32(), "text": pa.string(), "first_text": pa.string(), "first_print": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([row.get(k)], t) for k, t in types.items()], names=list(types))

    stage = scratch.put(dealt.mapInArrow(rows, _RESULT + ", task int, text string, first_text string, first_print string"))
    ends = stage.filter("task is not null")
    # One small row a task: the task after each, in order, and the first after the last.
    tasks = ends.select("task")
    after = tasks.select("task", F.lead("task").over(Window.orderBy("task")).alias("after")).crossJoin(F.broadcast(tasks.agg(F.min("task").alias("least"))))
    after = after.select("task", F.coalesce("after", "least").alias("after"))
    firsts = ends.select(F.col("task").alias("after"), F.col("first_text").alias("next_text"), F.col("first_print").alias("next_print"))
    pairs = ends.select("task", "id", "text", "fingerprint").join(after, "task").join(firsts, "after").select("id", "text", "fingerprint", "next_text", "next_print")

    def last(batches):
        for batch in batches:
            c = [x.to_pylist() for x in batch.columns]
            if c[0]:
                yield _judged(*c, shared.value)

    return stage.filter("task is null").select(*_NAMES).unionByName(pairs.mapInArrow(last, _RESULT))
