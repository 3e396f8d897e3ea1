"""Numpy kernels shared by the text operators: Arrow text as bytes, words, substring hashes.

All of them work on blocks of whole documents, so a task holds a few megabytes at a time, plus one
document where that is longer than a block.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

U64 = np.uint64
BLOCK = 1 << 19
# Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Odd multipliers of the two polynomial hashes, drawn once at random.
MULTIPLIERS = (0x9F3C2D61B5E8A747, 0xC1B7E64F2A95D30B)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one, so that every bit depends on every bit."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(31)
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


@cache
def _powers(multiplier: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to 2**bits of the multiplier and of its inverse modulo 2**64."""
    out = []
    for base in (multiplier, pow(multiplier, -1, 1 << 64)):
        p = np.ones(1 << bits, U64)
        n, step = 1, base
        while n < len(p):
            p[n:2 * n] = p[:n] * U64(step)
            n, step = 2 * n, step * step % (1 << 64)
        out.append(p)
    return out[0], out[1]


class Substrings:
    """Hashes of any substrings of a sequence, from one prefix sum.

    A polynomial modulo 2**64: crafted sequences of some hundred symbols and more can share a value, so it
    is for sequences shorter than that, or where equal values are compared again.
    """

    def __init__(self, symbols: np.ndarray, which: int = 0):
        bits = max(19, int(len(symbols)).bit_length())
        up, self.down = _powers(MULTIPLIERS[which], bits)
        self.sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum((symbols.astype(U64) + U64(1)) * up[:len(symbols)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null reads as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0]:offsets[-1]]


def blocks(offsets: np.ndarray, limit: int = BLOCK, rows: int = 1 << 10) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ``rows`` rows, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def numbered_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each word, the same for the same bytes within the block, and the bytes by number."""
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts] += 1
    marks[ends] -= 1
    inside = np.cumsum(marks[:-1], dtype=np.int8).view(bool)
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    column = column.dictionary_encode()
    return column.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary


class _Digests(dict):
    """Hash of each word seen, kept up to a bound and then started anew; this changes speed only."""

    KEPT = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.KEPT:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_digests = _Digests()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes.

    Up to seven bytes are the value themselves, with their number in the eighth, scrambled one to one: different
    words differ. Longer words of the block are looked up once each, under a function for which no two words with one value are
    known; polynomials of the bytes have such words.
    """
    number, words = numbered_words(data, starts, ends)
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    lengths, held = np.diff(offsets), words.buffers()[2]
    raw = np.zeros((held.size if held else 0) + 8, np.uint8)
    if held:
        raw[:held.size] = np.frombuffer(held, np.uint8)
    lanes = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    short = lengths < 8
    size = lengths[short].astype(U64)
    out = np.empty(len(words), U64)
    out[short] = mix(lanes[offsets[:-1][short]] & ((U64(1) << size * U64(8)) - U64(1)) | size << U64(56))
    long = np.flatnonzero(~short)
    out[long] = np.fromiter(map(_digests.__getitem__, words.take(pa.array(long)).to_pylist()), U64, len(long))
    return out[number]


class Words:
    """Words of a block of documents: byte ranges, document of each, 64-bit hashes."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, hashed: bool = True):
        """``offsets`` starts at 0 and closes each document; words never cross documents."""
        token = ~IS_SEPARATOR[data]
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = False, token
        before[offsets] = False
        after = np.empty(len(data) + 1, bool)
        after[-1], after[:-1] = False, token
        cut = after[1:].copy()
        cut[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(token & ~before[:-1])
        self.ends = np.flatnonzero(token & ~cut) + 1
        self.first = np.searchsorted(self.starts, offsets)  # first word of each document, then their number
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        if hashed:
            self.hashes = word_hashes(data, self.starts, self.ends)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges start, start + 1, ..., one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i, 0 for empty ranges."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i + width] for each i with a whole window."""
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def map_blocks(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Apply ``fn`` to Arrow batches in the tasks; ``fn`` must not keep state that a retry would miss."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
    return df.mapInArrow(run, schema)


def lists(first: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists values[first[i]:first[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def extended(df: DataFrame, added: str) -> StructType:
    """Schema of ``df`` with these columns after its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])
