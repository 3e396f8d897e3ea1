"""Fill-in-the-middle documents: code points counted and found in UTF-8, eight bytes at a time.

The texts of a block lie in one byte array that is viewed as 64-bit words. Shifts and masks mark in
each word the bytes that end a code point (the next byte is no continuation byte); the marks of a word
are counted at once, a running sum over words gives the code points before each word. The k-th code
point is found by binary search for its word and, inside the word, by comparing all eight running
counts with k in one subtraction.

Prefix, middle and suffix are cut at two places drawn from a hash of the key, the form from the same
hash: ``plain`` (the text), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each
part behind its mark. Texts are handled whole. Null and empty texts, and texts that hold a mark, are
plain. A null key is hashed as no digits at all; equal keys draw equal numbers, repeated rows stay rows
of their own, empty tables give empty results. Extra columns are ignored. Strings are taken to be UTF-8.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blocks, extended, map_blocks, text_bytes

U64 = np.uint64
ONES = U64(0x0101010101010101)  # one in each byte
TOPS = U64(0x8080808080808080)  # the top bit of each byte
MARKS = ("<P>", "<S>", "<M>")


class Units:
    """Code points of a block of UTF-8 bytes: how many before a byte, and where the k-th ends."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
        padded[:len(data)] = data
        words = padded.view("<u8")
        opens = ~((words >> U64(7)) & ~(words >> U64(6))) & ONES  # no continuation byte (10xxxxxx)
        self.ends = opens >> U64(8)
        self.ends[:-1] |= opens[1:] << U64(56)
        self.ends.view(np.uint8)[offsets[1:][np.diff(offsets) > 0] - 1] = 1  # the last byte of each text, whatever follows
        counts = np.bitwise_count(self.ends).astype(np.int64)
        self.upto = np.cumsum(counts)
        self.before = self.upto - counts

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Code points that end before each byte."""
        word, inside = places // 8, (places % 8).astype(U64)
        below = (U64(1) << (inside * U64(8))) - U64(1)
        return self.before[word] + np.bitwise_count(self.ends[word] & below)

    def select(self, numbers: np.ndarray) -> np.ndarray:
        """Byte after the end of the k-th code point, k from 1; 0 for k = 0."""
        word = np.searchsorted(self.upto, numbers)
        rest = np.maximum(numbers - self.before[word], 0).astype(U64)
        running = self.ends[word] * ONES  # in each byte the marks up to it
        reached = ((running | TOPS) - rest * ONES) & TOPS
        return np.where(numbers > 0, word * 8 + 9 - np.bitwise_count(reached), 0)


def draws(key: str | Column, seed: int = 1) -> list[Column]:
    """Four 32-bit numbers of each key: groups of eight hexadecimal digits of the hash of ``seed:key``."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
                   marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``key``, ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output`` of every text.

    One scan, no shuffle.
    """
    p, s, m = (mark.encode() for mark in marks)

    def run(batch):
        offsets, data = text_bytes(batch.column(1))
        numbers = np.stack([np.asarray(batch.column(c)) for c in range(2, 6)]).astype(np.int64)
        for i, j in blocks(offsets):
            at, part = offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]]
            units, h = Units(at, part), numbers[:, i:j]
            base = units.rank(at[:-1])
            n = units.rank(at[1:]) - base
            low, high = np.sort(h[:2] % (n + 1), axis=0)
            cuts = [np.where(k > 0, units.select(base + k), at[:-1]) for k in (low, high)]
            out, forms = [], []
            for d, (a, b, c, e) in enumerate(zip(at[:-1].tolist(), *(x.tolist() for x in cuts), at[1:].tolist())):
                whole = part[a:e].tobytes()
                if not whole or h[2, d] % 100 >= 100 - plain_percent or p in whole or s in whole or m in whole:
                    forms.append("plain")
                    out.append(whole)
                    continue
                prefix, middle, suffix = whole[:b - a], whole[b - a:c - a], whole[c - a:]
                spm = h[3, d] % 100 < spm_percent
                forms.append("spm" if spm else "psm")
                out.append(b"".join([s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle]))
            plain = np.array([f == "plain" for f in forms])
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[i:j], pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(low, pa.int64(), mask=plain),
                pa.array(high - low, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    numbers = [c.alias(f"h{i}") for i, c in enumerate(draws(key, seed), 1)]
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_blocks(df.select(key, text, *numbers), schema, run).withColumnRenamed("key", key)


def parts(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text behind an output: each part ends at the first mark that follows, for no part holds one."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    if form not in ("psm", "spm") or not output.startswith(first):
        raise ValueError(f"no output of the form {form}")
    one = output.index(second, len(first))
    two = output.index(m, one + len(second))
    before, after, middle = output[len(first):one], output[one + len(second):two], output[two + len(m):]
    return before + middle + after if form == "psm" else after + middle + before


def restore(df: DataFrame, output: str = "output", form: str = "form", restored: str = "restored", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``df`` with the exact text rebuilt from output and form; null outputs give null, a form that does not fit is an error."""
    known = tuple(mark.encode() for mark in marks)
    df = df.drop(restored)
    at, kind = df.columns.index(output), df.columns.index(form)

    def run(batch):
        outputs, forms = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(kind).to_pylist()
        texts = [None if o is None else parts(o, f, known) for o, f in zip(outputs, forms)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, restored])

    return map_blocks(df, extended(df, f"`{restored}` string"), run)
