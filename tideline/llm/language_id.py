"""Language identification by compression: the language whose dictionary makes a text smallest.

Every language has a raw-content zstandard dictionary: running text of sample rows, whole, one after the other.  Texts are
lower-cased and everything but letters becomes a blank.  A text is cut into chunks (at character boundaries, so all of it
counts) and each chunk is compressed with every dictionary; the language with the smallest total wins.  The margin is what
the next best takes more, in bytes; a text with a narrow margin is rejected.

Dictionaries are fitted on a bounded sample: of every language the `rows` labelled rows with the smallest hash of their
text.  The same rows are taken on every run.

Defined results: null texts and texts without a letter are `und` with score 0 and are rejected; equal totals go to the
language with more labelled rows; with no labelled row at all every text is `und`; repeated rows are judged alike;
other columns pass through, and ones named like the added columns are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.scratch import small_batches

_OTHER = re.compile(r"[\W\d_]+")
#: Sample rows of a language, and the compression level.
ROWS, LEVEL = 200, 6
ADDED = ("lang_pred", "score", "margin", "rejected")


@dataclass
class Languages:
    names: list[str]
    contents: list[bytes]
    level: int = LEVEL
    chunk: int = 2000


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, level: int = LEVEL) -> Languages:
    """Dictionaries from a sample of at most `rows` rows a language, each with its whole text."""
    rows_of = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["c"] for r in rows_of.groupBy("lang").agg(F.count("*").alias("c")).collect()}
    if not counts:
        return Languages([], [], level)
    passing = F.create_map(*(F.lit(x) for k, c in counts.items() for x in (k, min(1.0, 4 * rows / c))))
    # About four times the rows wanted pass a threshold on the hash; the first of those by hash are taken.
    near = rows_of.withColumn("h", F.xxhash64("text")).filter(F.pmod(F.col("h"), F.lit(1 << 30)) < passing[F.col("lang")] * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h")
    chosen = near.select("lang", "h").distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rows)
    sample = near.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "k").agg(F.min("text").alias("text")).collect()
    held: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["k"])):
        held.setdefault(r["lang"], []).append(r["text"])
    names = sorted(held, key=lambda x: (-counts[x], x.encode()))
    # Labels are taken with a pinch of salt: rows that another language fits better, by dictionaries of the other half of the
    # rows, are left out.
    halves = [{x: held[x][k::2] for x in names} for k in (0, 1)]
    kept: dict[str, list] = {x: [] for x in names}
    for own, other in (halves, halves[::-1]):
        model = build(names, other, level)
        for k, x in enumerate(names):
            kept[x] += [t for t, sizes in zip(own[x], _sizes(own[x], model)) if sizes[k] <= min(sizes)]
    return build(names, {x: kept[x] or held[x] for x in names}, level)


def build(names: list[str], held: dict[str, list[str]], level: int = LEVEL) -> Languages:
    return Languages(names, [" ".join(["", *map(_plain, held[x]), ""]).encode("utf-8", "surrogatepass") for x in names], level)


def _plain(text: str) -> str:
    """Lower case, letters only, single blanks."""
    return _OTHER.sub(" ", text.lower()).strip()


def _sizes(texts, model: Languages):
    """Total compressed bytes of every text by language."""
    packers = []
    for content in model.contents:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=model.level)
        packers.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    step = model.chunk
    for text in map(_plain, texts):
        parts = [text[i : i + step].encode("utf-8", "surrogatepass") for i in range(0, len(text), step)]
        yield [sum(len(pack(p)) for p in parts) for pack in packers]


def _judge(shared, text_at: int, least_margin: float):
    def rows(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            m = len(texts)
            lang, score, margin, rejected = ["und"] * m, np.zeros(m), np.zeros(m), np.ones(m, bool)
            judged = [i for i, t in enumerate(texts) if t and model.names and any(map(str.isalpha, t))]
            for i, sizes in zip(judged, _sizes((texts[i] for i in judged), model)):
                best = min(range(len(sizes)), key=sizes.__getitem__)
                rest = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
                lang[i], margin[i] = model.names[best], rest - sizes[best]
                score[i] = 1 / (1 + 2.0 ** -min(margin[i], 60))
                rejected[i] = margin[i] < least_margin
            added = [pa.array(lang), pa.array(score), pa.array(margin), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *ADDED])

    return rows


def identify(docs: DataFrame, model: Languages, *, text_col: str = "text", least_margin: float = 1.0) -> DataFrame:
    """docs with lang_pred, score (0 to 1), margin (bytes) and rejected."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ADDED]
    own = docs.select(*(F.col(f"`{c}`") for c in names))
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*own.schema, *(T.StructField(n, k) for n, k in zip(ADDED, kinds))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(_judge(shared, names.index(text_col), least_margin), schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: those outside the held-out fifth."""
    return docs.filter(F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(0)) != 0)
