"""Rewriting whole texts by a dictionary: an automaton of all patterns, leftmost-longest, spans replaced; and respelling of
the stretches of a text that are written in other letters.

A dictionary (pattern, replacement) is as large as it needs to be. One of `block` patterns at most is an automaton that is
broadcast and reads every text once. Of a larger one no task holds more than its texts ask for: a pattern is known by its first
words, groups of texts, of some millions of characters each, say which of those they have, and a join brings each group its own
patterns, of which its automaton is made. Texts are dealt out and read twice then, whatever the dictionary's size.

Defined results: patterns match whole words only (no letter, digit or underscore of any script beside them), case counts;
of overlapping hits the leftmost stays, of those the longest; replacements are not read again; null and empty patterns match
nothing; of rows that repeat a pattern the least replacement counts; null texts stay null; an empty dictionary changes
nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.lineage import cut

_automata: dict[str, ahocorasick.Automaton] = {}
_WORD, _OTHER = re.compile(r"\w+"), re.compile(r"\W+")  # as _part_of_word has it


def _made(entries: Iterable[tuple[str, str]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for pattern, replacement in entries:
        a.add_word(pattern, (len(pattern), replacement))
    a.make_automaton()
    return a


def _automaton(key: str, entries: list[tuple[str, str]]) -> ahocorasick.Automaton:
    if key not in _automata:
        _automata.clear()
        _automata[key] = _made(entries)
    return _automata[key]


def _part_of_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def hits_in(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Hits on whole words: start, length in characters, and what to put there."""
    out, last = [], len(text) - 1
    for end, (n, replacement) in automaton.iter(text):
        start = end - n + 1
        if (start == 0 or not _part_of_word(text[start - 1])) and (end == last or not _part_of_word(text[end + 1])):
            out.append((start, n, replacement))
    return out


def _put(told: list[str | None], a: ahocorasick.Automaton, kind: pa.DataType) -> list[pa.Array]:
    done = [put_in(t, hits_in(t, a) if t and len(a) else []) for t in told]
    return [pa.array([t for t, _ in done], kind), pa.array([n for _, n in done], pa.int32())]


def _put_alike(texts: DataFrame, col: str, entries: list[tuple[str, str]]) -> DataFrame:
    """Texts read once and their hits replaced by the same entries for all."""
    shared, key, at = texts.sparkSession.sparkContext.broadcast(entries), uuid.uuid4().hex, texts.columns.index(col)

    def run(batches):
        for batch in batches:
            columns = batch.columns
            columns[at], many = _put(batch.column(at).to_pylist(), _automaton(key, shared.value), batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, many], names=[*batch.schema.names, "n_rewritten"])

    return texts.mapInArrow(run, _rewritten(texts))


def _rewritten(texts: DataFrame) -> T.StructType:
    return T.StructType([*texts.schema, T.StructField("n_rewritten", T.IntegerType())])


def key_of(pattern: str) -> tuple[str, int]:
    """What a text must have for the pattern to stand in it, and how many words that is: the pattern's first two words, its only
    word, or else how it begins."""
    words = _WORD.findall(pattern)[:2]
    return " ".join(words) or pattern[:4], len(words)


def keys_in(text: str, sorts: set[int]) -> set[str]:
    """The keys, of so many words, of all patterns that could stand in a text: neighbouring words, words, and what begins anywhere
    between words."""
    words = _WORD.findall(text)
    keys = set(words) if 1 in sorts else set()
    if 2 in sorts:
        keys.update(map(" ".join, zip(words, words[1:])))
    if 0 in sorts:
        keys.update(s[i : i + n] for s in set(_OTHER.findall(text)) for i in range(len(s)) for n in range(1, 5))
    return keys


def _keyed(batches):
    for batch in batches:
        keys = [key_of(p) for p in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k for k, _ in keys], pa.string()), pa.array([n for _, n in keys], pa.int32())], ["p", "r", "key", "sort"])


def _asking(col: str, known: DataFrame, count: int):
    """What gives (_group, key): the keys in a group's texts that the dictionary may have. A bitmap of the hashes of its keys, of 16
    MB at most, leaves out most others."""
    size = 1 << max(15, min(27, (16 * count).bit_length()))
    place = F.crc32(F.col("key").cast("binary")).bitwiseAND(F.lit(size - 1)) + 1
    parts = known.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for k, part in parts:
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(part, np.uint8)
    sorts = {r.sort for r in known.select("sort").distinct().collect()}
    shared = known.sparkSession.sparkContext.broadcast(bits)

    def run(key, texts):
        bits, keys = shared.value, list(set().union(*(keys_in(t, sorts) for t in texts[col].to_pylist() if t)))
        at = np.fromiter((crc32(k.encode()) for k in keys), np.int64, len(keys)) & (size - 1)
        some = [keys[i] for i in np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist()]
        return pa.table({"_group": pa.array([key[0].as_py()] * len(some), pa.int64()), "key": pa.array(some, pa.string())})

    return run


def rewrite(texts: DataFrame, col: str, dictionary: DataFrame, pattern: str = "pattern", replacement: str = "replacement", *, block: int = 50_000, group_chars: int = 4_000_000) -> DataFrame:
    """texts with `col` rewritten, and n_rewritten, the number of spans replaced. A dictionary of `block` patterns at most is
    broadcast; of a larger one each group of texts, of about `group_chars` characters, is brought those whose first words it has.
    Rows are dealt into groups by all their columns, so that copies of a text, under other ids, are not one group's."""
    known = cut(dictionary.filter(F.length(pattern) > 0).groupBy(F.col(pattern).alias("p")).agg(F.min(F.coalesce(replacement, F.lit(""))).alias("r")))
    out = texts.select(*(F.col(f"`{c}`") for c in texts.columns if c not in ("_group", "n_rewritten")))
    count = known.count()
    if count <= block:
        return _put_alike(out, col, [(p, r) for p, r in known.collect()])
    known = cut(known.mapInArrow(_keyed, "p string, r string, key string, sort int"))
    chars = out.agg(F.sum(F.length(f"`{col}`"))).first()[0] or 0
    groups = max(texts.sparkSession.sparkContext.defaultParallelism, chars // group_chars)
    dealt = out.withColumn("_group", F.pmod(F.xxhash64(*(F.col(f"`{f.name}`") for f in out.schema if "map<" not in f.dataType.simpleString())), F.lit(groups)))
    asked = dealt.groupBy("_group").applyInArrow(_asking(col, known, count), "_group long, key string")
    # The dictionary is sorted, never broadcast: its files are small for its rows.
    brought = asked.join(known.hint("merge"), "key").select("_group", "p", "r")

    def put(texts, known):
        told, many = _put(texts[col].to_pylist(), _made(zip(known["p"].to_pylist(), known["r"].to_pylist())) if known.num_rows else _made([]), texts.schema.field(col).type)
        texts = texts.drop_columns(["_group"])
        return texts.set_column(texts.schema.get_field_index(col), texts.schema.field(col), told).append_column("n_rewritten", many)

    return dealt.groupBy("_group").cogroup(brought.groupBy("_group")).applyInArrow(put, _rewritten(out))


def put_in(text: str | None, hits: list[tuple[int, int, str]]) -> tuple[str | None, int]:
    """The text with its hits replaced, leftmost and then longest first, and how many were."""
    if text is None or not hits:
        return text, 0
    parts, end, many = [], 0, 0
    for start, n, put in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start >= end:
            parts += [text[end:start], put]
            end, many = start + n, many + 1
    return "".join([*parts, text[end:]]), many


def respell_runs(text: Column, run: str, kinds: dict[str, str], letters: list[tuple[str, str]]) -> Column:
    """A text whose stretches that match `run` (whole words in other letters, joined by blanks) are spelt anew: a first word
    that names a kind of place becomes the kind behind the rest; of all other words every letter is spelt by itself, and
    begins with a capital. Nothing else of the text changes. kinds and letters are tables of tens of entries."""
    names = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))

    def spelt(word: Column) -> Column:
        for letter, latin in letters:
            word = F.replace(word, F.lit(letter), F.lit(latin))
        return F.concat(F.upper(F.left(word, F.lit(1))), F.substr(word, F.lit(2)))

    def anew(piece: Column) -> Column:
        words = F.split(piece, " ")
        kind = F.when(F.size(words) > 1, F.element_at(names, F.lower(words[0])))
        rest = F.when(kind.isNotNull(), F.slice(words, 2, F.size(words))).otherwise(words)
        said = F.array_join(F.transform(rest, spelt), " ")
        return F.when(kind.isNotNull(), F.concat(said, F.lit(" "), kind)).otherwise(said)

    # Pieces: a run, or what stands between two; the text is all of them end to end.
    marked = F.regexp_replace(text, f"({run})", "\u0001$1\u0002")
    pieces = F.split(marked, "\u0002")
    return F.array_join(F.transform(pieces, lambda p: F.when(F.contains(p, F.lit("\u0001")), F.concat(F.split_part(p, F.lit("\u0001"), F.lit(1)), anew(F.split_part(p, F.lit("\u0001"), F.lit(2))))).otherwise(p)), "")


#: Classes of like-sounding consonants (fixed values); letters of no class are not heard.
SOUNDS = {"b": "B", "p": "B", "c": "K", "q": "K", "k": "K", "g": "K", "d": "T", "t": "T", "f": "F", "v": "F", "j": "J", "l": "L", "m": "M", "n": "N", "ñ": "N", "r": "R", "s": "S", "z": "S", "ç": "S", "ß": "S", "x": "S"}


def sound_key(word: Column) -> Column:
    """A word by its consonants: like-sounding ones are one, others drop out, neighbours that are equal are one."""
    lower = F.lower(word)
    heard = F.translate(lower, "".join(SOUNDS), "".join(SOUNDS.values()))
    return F.regexp_replace(F.regexp_replace(heard, "[^A-Z]", ""), r"(.)\1+", "$1")
