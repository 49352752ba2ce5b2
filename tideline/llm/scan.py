"""Vectorised word scanning of Arrow string columns, shared by the operators of this subpackage.

Texts are read as the UTF-8 bytes of an Arrow column; words are runs of bytes of a class, so that one pass of numpy over
the buffer finds every word of every text of a batch.  Null texts have no words.  Hashes are 64 bits wide: a word's is a
polynomial over random byte values, finished by a mixer, so it does not depend on where the word stands.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]

#: Anything but blank and the control characters tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits, and every byte of a character beyond ASCII.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[0x30:0x3A] = WORDLIKE[0x41:0x5B] = WORDLIKE[0x61:0x7B] = WORDLIKE[0x80:] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; as long as the longest text or about a million bytes."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


@dataclass
class Words:
    """Words of consecutive texts: byte spans in data, hashes, and first[i]:first[i+1] as the words of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column (nulls are empty)."""
    if pa.types.is_large_string(column.type) is False:
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if off is not None and off.size else np.zeros(n + 1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan(column: pa.Array, kind: np.ndarray = NOT_SPACE, chunk: int = 1 << 20):
    """Words of a column, in runs of whole texts of about chunk bytes: yields (first text, Words)."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, "right")) - 1)
        yield i, _scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], kind)
        i = j


def _scan(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    size = len(data)
    if not size:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), offsets)
    inside = kind[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before = np.empty(size, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(size, bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    p, inv = powers(size + 1)
    sums = np.empty(size + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[data] * p[:size], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets), offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, by the first word's place; len(hashes) - n + 1 of them."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    c = 0x9E3779B97F4A7C15
    for k in range(n):
        out += hashes[k : k + m] * U(pow(c, 2 * k + 1, 1 << 64))
    return mix(out)


def run_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole run of words, as grams() has it for the run's length."""
    return grams(hashes, len(hashes))[0]
