"""Alignment of two tokenizers' tokens of the same text, and how often two tokens stand for each other in a corpus.

Both tokenizers spell the same bytes: a space and the text.  Token offsets are bytes, so a token's span is from its start to
the next start.  An overlap of two spans shows at the later of their starts, which the other token covers; so one backward
as-of merge from each side, keyed by document, finds for every start the other side's covering token, and the union of both
directions is all overlaps (the second direction leaves out equal starts, which the first has).  Places where a token of
either side ends cut the document into groups.

Counts over the corpus: a pair of ids is counted once a document.  Pairs that are in most documents are few - documents
times pairs a document, over the least count - so the `most_common` most frequent pairs are broadcast (8 + 4 bytes each) and
summed where the document is; all others are joined as rows, whose keys are rare by then.  The counts' best partner of each
id is a table of one row an id of A's vocabulary.

Encoding goes by stretches between a blank and what stands before it, as both tokenizers never merge over a blank that
follows another character (checked for the vocabulary when it is read); a worker remembers the stretches that it has
encoded, up to `MEMORY` of them, and forgets all when there are more.

Defined results: null and empty texts, and texts whose bytes a tokenizer does not give back, have no tokens: zeros and the
empty string; special tokens' strings in a text are plain text; rows that repeat an id are documents of their own; other
columns pass through, those named like the added ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.scratch import Scratch, small_batches
from tideline.llm.token_counts import PATTERN

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MEMORY = 300_000
#: Bytes of text that are merged at once.
BATCH = 1 << 20
_OWN = ("n_a", "n_b", "n_groups", "n_links", "groups")
ADDED = (*_OWN, "n_best", "count_sum")


def byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level_vocabulary(path: str) -> dict[bytes, int]:
    """Bytes and ids of a byte-level BPE file, without special tokens. Ids are ranks: merges come in order of their ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    known, special = byte_of_character(), {t["content"] for t in model.get("added_tokens", [])}
    return {bytes(known[c] for c in t): k for t, k in model["model"]["vocab"].items() if t not in special}


@dataclass
class Vocabularies:
    """What the tasks need of both tokenizers: the byte-level ranks and the piece model's file."""

    ranks: dict[bytes, int]
    model: bytes


def vocabularies(byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> Vocabularies:
    with open(pieces, "rb") as f:
        return Vocabularies(byte_level_vocabulary(byte_bpe), f.read())


_BOUNDARY = re.compile(r"(?<=\S)(?= )")
_IRREGULAR = re.compile(r"(?:^|\s) |\s$")
_CROSSES = re.compile("[^▁]▁")


class Ragged:
    """Rows of whole numbers end to end, grown at the end and read by row."""

    def __init__(self):
        self.values, self.ends, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def extend(self, rows: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        begin, m = int(self.ends[self.n]), len(rows)
        end = begin + int(sizes.sum())
        if end > len(self.values):
            self.values = np.resize(self.values, 2 * end)
        if self.n + m >= len(self.ends):
            self.ends = np.resize(self.ends, 2 * (self.n + m + 1))
        self.values[begin:end] = np.fromiter(chain.from_iterable(rows), np.int32, end - begin)
        self.ends[self.n + 1 : self.n + m + 1] = begin + np.cumsum(sizes)
        self.n += m

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of these rows end to end, and the size of each row."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        before = np.cumsum(sizes) - sizes
        return self.values[np.repeat(self.ends[rows] - before, sizes) + np.arange(int(sizes.sum()))], sizes


class Encoder:
    """Both tokenizers in a worker, with what they made of the stretches met so far."""

    def __init__(self, own: Vocabularies):
        self.a = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=own.model)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(n)]
        if any(_CROSSES.search(p) for p in pieces):
            raise ValueError("pieces of this model go over blanks: its texts cannot be encoded by stretches")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.bytes_a = [b""] * (max(own.ranks.values()) + 1)
        for t, k in own.ranks.items():
            self.bytes_a[k] = t
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # What is written of an id: inside a list, at the end of A's list and at the end of a group.
        self.n_ids = max(len(self.size_a), len(self.size_b))
        self.written = np.array([f"{k}{mark}" for mark in ",|;" for k in range(self.n_ids)], object)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = (Ragged(), Ragged())
        self.wrong: set[int] = set()

    def learn(self, stretches: list[str]) -> None:
        """Each stretch begins with a blank, which the piece model adds by itself (but not to an empty string)."""
        first = len(self.at)
        found_a = [self.a.encode_ordinary(s) for s in stretches]
        found_b = self.b.encode([s[1:] for s in stretches], num_threads=1)
        for k, (s, a, b) in enumerate(zip(stretches, found_a, found_b)):
            if s == " ":
                found_b[k] = b = self.blank
            raw = s.encode()
            if not b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b)):
                self.wrong.add(first + k)
            self.at[s] = first + k
        self.ids[0].extend(found_a)
        self.ids[1].extend(found_b)

    @cached_property
    def blank(self) -> list[int]:
        """A single blank, as the end of a text has it: that of one more blank than the model's own."""
        two = self.b.encode(" ")
        return [k for k in range(len(self.bytes_b)) if self.bytes_b[k] == b" " and not self.b.is_byte(k)] if b"".join(self.bytes_b[k] for k in two) == b"  " else []

    def stretches(self, text: str) -> list[str]:
        """A blank and the text, cut before every blank that follows a character other than white space."""
        if _IRREGULAR.search(text):
            return _BOUNDARY.split(" " + text)
        return (" " + text.replace(" ", "\0 ")).split("\0") if "\0" not in text else [" " + w for w in text.split(" ")]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, document of each, ids of B, document of each), documents by their place; none of those without tokens."""
        cut = [self.stretches(t) if t else [] for t in texts]
        if len(self.at) > MEMORY:
            self.forget()
        fresh = set().union(*cut) - self.at.keys()
        if fresh:
            self.learn(sorted(fresh))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        places = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        docs = np.repeat(np.arange(len(texts)), sizes)
        if self.wrong and (bad := np.isin(places, np.fromiter(self.wrong, np.int64))).any():
            keep = ~np.isin(docs, docs[bad])
            places, docs = places[keep], docs[keep]
        out = []
        for side in self.ids:
            ids, n = side.take(places)
            out += [ids.astype(np.int64), np.repeat(docs, n)]
        return tuple(out)


@dataclass
class Alignment:
    """Tokens and overlaps of the documents of a batch; doc_* are places in the batch, link_* places of tokens, group_* the
    number of a token's group in the batch."""

    ids_a: np.ndarray
    doc_a: np.ndarray
    ids_b: np.ndarray
    doc_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def _keyed(ids: np.ndarray, docs: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens as one number a place: the document above, the byte in it below."""
    end = np.cumsum(sizes[ids])
    start = end - sizes[ids]
    base = np.append(start, 0)[np.searchsorted(docs, np.arange(n))][docs]
    return (docs << 40) + start - base, (docs << 40) + end - base


def align(own: Encoder, texts: list[str | None]) -> Alignment:
    ids_a, doc_a, ids_b, doc_b = own.encode(texts)
    (start_a, end_a), (start_b, end_b) = _keyed(ids_a, doc_a, own.size_a, len(texts)), _keyed(ids_b, doc_b, own.size_b, len(texts))
    a, b = pd.DataFrame({"at": start_a, "a": np.arange(len(ids_a))}), pd.DataFrame({"at": start_b, "b": np.arange(len(ids_b))})
    # The document is the upper part of the key, and every document begins with a token of either side: the last start
    # at or before a place is one of its own document.
    covering_b = pd.merge_asof(a[["at"]], b, on="at")["b"].to_numpy(np.int64)
    covering_a = pd.merge_asof(b[["at"]], a, on="at")["a"].to_numpy(np.int64)
    inside = start_b > start_a[covering_a]
    link_a = np.concatenate([np.arange(len(ids_a)), covering_a[inside]])
    link_b = np.concatenate([covering_b, np.flatnonzero(inside)])
    # A group ends where both sides end; a token's group is the number of such ends before its own.
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    return Alignment(ids_a, doc_a, ids_b, doc_b, link_a, link_b, np.searchsorted(both, end_a), np.searchsorted(both, end_b))


def group_texts(own: Encoder, x: Alignment, n: int) -> tuple[list[str], np.ndarray]:
    """Of each of n documents the groups as `a1,a2|b1;a3|b2,b3` (ids in order), and their number."""
    key = np.concatenate([x.group_a * 2, x.group_b * 2 + 1])
    order = np.argsort(key, kind="stable")
    key, ids, docs = key[order], np.concatenate([x.ids_a, x.ids_b])[order], np.concatenate([x.doc_a, x.doc_b])[order]
    last = np.append(key[1:] != key[:-1], True)[: len(key)]
    marks = np.where(last, 1 + key % 2, 0)
    written = own.written[marks * own.n_ids + ids].tolist()
    bounds = np.searchsorted(docs, np.arange(n + 1)).tolist()
    return ["".join(written[i:j])[:-1] for i, j in zip(bounds, bounds[1:])], np.bincount(docs[marks == 2], minlength=n)


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, shared) -> Encoder:
    """One a worker, kept between tasks: reading the vocabularies takes longer than a batch."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def _parts(texts: list[str | None]):
    """Spans of a batch with about BATCH characters each; a longer text is a span of its own."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t or "") > BATCH:
            yield first, k
            first, size = k, 0
        size += len(t or "")
    if len(texts) > first:
        yield first, len(texts)


def alignments(spark: SparkSession, docs: DataFrame, own: Vocabularies, *, text_col: str = "text", digest: bool = False) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, groups (their text, or with digest the SHA-256 of it; '' without tokens) and
    the distinct id pairs that overlap, as _pairs (id of A times B's vocabulary plus id of B, 8 bytes each) and _times."""
    small_batches(spark)
    shared, key = spark.sparkContext.broadcast(own), uuid.uuid4().hex
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (*ADDED, "_pairs", "_times")))
    at = kept.columns.index(text_col)
    names = [*_OWN, "_pairs", "_times"]

    def rows(batches):
        for batch in batches:
            enc, texts, parts = _encoder(key, shared), batch.column(at).to_pylist(), []
            for i, j in _parts(texts):
                x, n = align(enc, texts[i:j]), j - i
                written, groups = group_texts(enc, x, n)
                code, link_doc = x.ids_a[x.link_a] * len(enc.size_b) + x.ids_b[x.link_b], x.doc_a[x.link_a]
                order = np.argsort(link_doc, kind="stable")
                code, bounds = code[order], np.searchsorted(link_doc[order], np.arange(n + 1)).tolist()
                pairs, times = zip(*(np.unique(code[p:q], return_counts=True) for p, q in zip(bounds, bounds[1:])))
                out = [sha256(w.encode()).hexdigest() if w else "" for w in written] if digest else written
                columns = [np.bincount(x.doc_a, minlength=n), np.bincount(x.doc_b, minlength=n), groups, np.diff(bounds)]
                parts.append([*(pa.array(c, pa.int64()) for c in columns), pa.array(out, pa.string()), pa.array([p.tobytes() for p in pairs], pa.binary()), pa.array([t.astype(np.int32).tobytes() for t in times], pa.binary())])
            if parts:
                added = [pa.concat_arrays(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    kinds = [T.LongType()] * 4 + [T.StringType(), T.BinaryType(), T.BinaryType()]
    return kept.mapInArrow(rows, T.StructType([*kept.schema, *(T.StructField(c, k) for c, k in zip(names, kinds))]))


def _document_counts(batches):
    """(pair, docs): in how many documents of a task each pair is, counted over some millions of pairs at once."""
    held, size = [], 0

    def counted():
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        for k in range(0, len(pairs), 1 << 16):
            yield pa.record_batch([pa.array(pairs[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], ["pair", "docs"])

    for batch in batches:
        for raw in batch.column(0).to_pylist():
            held.append(np.frombuffer(raw, np.int64))
            size += len(held[-1])
            if size > 1 << 22:
                yield from counted()
                held, size = [], 0
    if held:
        yield from counted()


@dataclass
class CrossAlignment:
    """documents: docs with the columns of ADDED; pairs: (a, b, docs), in how many documents ids a and b overlap."""

    documents: DataFrame
    pairs: DataFrame


def cross_align(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, own: Vocabularies | None = None, digest: bool = False, most_common: int = 1 << 20) -> CrossAlignment:
    """Aligns all documents; keep: the columns of docs that the result has (all by default)."""
    own, scratch = own or vocabularies(), Scratch(spark, "token-alignment")
    n_b = sentencepiece.SentencePieceProcessor(model_proto=own.model).get_piece_size()
    names = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    aligned = alignments(spark, docs, own, text_col=text_col, digest=digest).select(*(F.col(f"`{c}`") for c in names), *_OWN, "_pairs", "_times")
    aligned = scratch.put(aligned.withColumn("_row", F.monotonically_increasing_id()))  # the written number stays
    counts = scratch.put(aligned.select("_pairs").mapInArrow(_document_counts, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")))
    a_of = F.floor(F.col("pair") / n_b)
    best = counts.groupBy(a_of.alias("a")).agg(F.max("docs").alias("most"))  # a row an id of A at most
    # Of the powers of two the least that no more than most_common pairs reach: 63 rows at most.
    sizes = sorted(((r["k"], r["n"]) for r in counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, many = 62, 0  # no pair is in as many documents
    for k, n in sizes:
        many += n
        if many > most_common:
            break
        least = k
    common = counts.filter(F.col("docs") >= 1 << least).join(F.broadcast(best), a_of == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    common = common.toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast(tuple(common[c].to_numpy() for c in ("pair", "docs", "best")))

    def look_up(batches):
        known, docs_of, is_best = shared.value
        for batch in batches:
            rows, times = batch.column(0).to_numpy(), [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            if not len(rows):
                continue
            doc, times = np.repeat(np.arange(len(rows)), list(map(len, times))), np.concatenate(times).astype(np.int64)
            pairs = np.concatenate([np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()])
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            d, t, at, rest = doc[found], times[found], at[found], ~found
            sums = [np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)]
            np.add.at(sums[0], d, t * is_best[at])
            np.add.at(sums[1], d, t * docs_of[at])
            none = pa.nulls(len(rows), pa.int64())
            yield pa.record_batch([pa.array(rows), none, none, *map(pa.array, sums)], ["_row", "pair", "times", "n_best", "count_sum"])
            none = pa.nulls(int(rest.sum()), pa.int64())
            yield pa.record_batch([pa.array(rows[doc[rest]]), pa.array(pairs[rest]), pa.array(times[rest]), none, none], ["_row", "pair", "times", "n_best", "count_sum"])

    looked = scratch.put(aligned.select("_row", "_pairs", "_times").mapInArrow(look_up, "_row long, pair long, times long, n_best long, count_sum long"))
    rare = counts.filter(F.col("docs") < 1 << least).join(F.broadcast(best), a_of == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))
    more = looked.filter("pair is not null").select("_row", "pair", "times").join(rare.hint("merge"), "pair")
    more = more.select("_row", (F.col("times") * F.col("best")).alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum"))
    sums = looked.filter("pair is null").select("_row", "n_best", "count_sum").unionByName(more).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    documents = aligned.drop("_pairs", "_times").join(sums.hint("merge"), "_row").select(*(F.col(f"`{c}`") for c in names), *ADDED)
    return CrossAlignment(documents, counts.select(a_of.cast("int").alias("a"), (F.col("pair") % n_b).cast("int").alias("b"), "docs"))
