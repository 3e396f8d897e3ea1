"""BPE encoding and decoding by batched merge rounds over flat numpy arrays.

The words of many texts are merged together. Their symbols lie in one flat array; each round looks
up all adjacent pairs by binary search over the sorted pair keys, takes the lowest rank of each
word and merges every occurrence of it, left to right. Words without a pair of the vocabulary drop
out. A table of words already merged is kept per task up to a bound, then started anew; it changes
speed only.

Texts are handled whole: null reads as empty, empty texts give no ids, very long texts go through
the same arrays. Equal texts give equal ids. Extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import extended, map_blocks, ragged

# Fixed values of byte-level BPE: the split pattern, and the characters that stand for bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^{S}\p{L}\p{N}]+|[{S}]+(?![^{S}])|[{S}]+"""
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

FULL = regex.compile(PATTERN.replace("{S}", SPACE))
# The same for texts of code points below 256, which the standard library matches faster.
LATIN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"""
                   .replace("{L}", r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff").replace("{N}", r"0-9\xb2\xb3\xb9\xbc-\xbe")
                   .replace("{S}", r"\t-\r \x85\xa0"))

KEPT_WORDS = 300_000


class Known(dict):
    """Number of each word, in the order of first sight; ``new`` holds those not merged yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


class Special(tuple):
    """A special token, apart from a word of the same letters."""

    def __new__(cls, token: str):
        return super().__new__(cls, (token,))


class Vocabulary:
    """Merges, ids and bytes of a byte-level BPE file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        ids = model["vocab"]
        # Bytes without a printed form take the code points from 256 on, in order.
        shown = {b: chr(b) for b in PRINTED}
        for b in range(256):
            shown.setdefault(b, chr(256 + b - sum(p < b for p in PRINTED)))
        byte_of = {c: b for b, c in shown.items()}
        self.byte_ids = np.array([ids[shown[b]] for b in range(256)], np.int64)
        self.size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        # Merging all occurrences of a pair at once is right only if no symbol is used before it is made.
        rank_made = np.full(self.size, -1)
        rank_made[made] = np.arange(len(made))
        if (np.maximum(rank_made[left], rank_made[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge uses a symbol of a later merge")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces: list[bytes] = [b""] * self.size
        for token, i in [*ids.items(), *self.special.items()]:
            known = all(c in byte_of for c in token)
            pieces[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        """Start the table of merged words anew; the special tokens come first, each as it is."""
        self.known = Known()
        for token in self.special:
            self.known[Special(token)]
        self.known.new.clear()
        self.flat = np.array(list(self.special.values()), np.int32)
        self.first = np.arange(len(self.special) + 1)

    def _look_up(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair of each place and the next one, or the number of merges where there is none."""
        none = len(self.ranks)
        after = np.minimum(at + 1, len(symbols) - 1)
        keys = symbols[at] * self.size + symbols[after]
        found = np.minimum(np.searchsorted(self.keys, keys), none - 1)
        same = (self.keys[found] == keys) & (word[at] == word[after]) & (after > at)
        return np.where(same, self.ranks[found], none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one word after the other, and where each word starts (and the end)."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(symbols))
        out_symbols, out_place = [], []
        none = len(self.ranks)
        rank = self._look_up(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            start = np.flatnonzero(np.append(True, word[:-1] != word[1:]))
            best = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(symbols)))
            best = np.repeat(best, size)
            done = best == none
            merged = np.flatnonzero((rank == best) & ~done)
            # Of overlapping occurrences (a run of one symbol) every second one merges.
            if len(merged) > 1:
                n = np.arange(len(merged))
                opens = np.append(True, np.diff(merged) > 1)
                merged = merged[(n - np.maximum.accumulate(np.where(opens, n, 0))) % 2 == 0]
            symbols[merged] = self.made[rank[merged]]
            changed = np.zeros(len(symbols), bool)
            changed[merged] = True
            keep = ~done
            keep[merged + 1] = False
            if done.any():
                out_symbols.append(symbols[done])
                out_place.append(place[done])
            symbols, word, place, rank, changed = symbols[keep], word[keep], place[keep], rank[keep], changed[keep]
            if len(symbols):
                changed[:-1] |= changed[1:]
                at = np.flatnonzero(changed)
                rank[at] = self._look_up(symbols, word, at)
        if not out_symbols:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        place = np.concatenate(out_place)
        order = np.argsort(place, kind="stable")
        bounds = np.append(0, np.cumsum(lengths))
        return np.concatenate(out_symbols)[order].astype(np.int32), np.searchsorted(place[order], bounds)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        known = self.known
        places = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in map(self._words, texts)]
        if known.new:
            flat, first = self.merge([w if isinstance(w, bytes) else w.encode() for w in known.new])
            known.new.clear()
            self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
            self.flat = np.concatenate([self.flat, flat])
        return [self.flat[ragged(self.first[at], self.first[at + 1] - self.first[at])] for at in places]

    def _words(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self._split(text)
        out = []
        for part in self.cut.split(text):
            out += [Special(part)] if part in self.special else self._split(part)
        return out

    @staticmethod
    def _split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return FULL.findall(text)
        return LATIN.findall(text)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 read as replacement characters."""
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes().decode("utf-8", "replace")


@cache
def _vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


def _runs(values: list[str], letters: int = 1 << 20):
    """Ranges of texts of about so many letters together."""
    i, total = 0, 0
    for j, v in enumerate(values):
        total += len(v)
        if total >= letters:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(values):
        yield i, len(values)


def encode(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every text; ``vocabulary`` is the path of a byte-level BPE file.

    The file is read once on the driver and travels with the tasks. One scan, no shuffle.
    """
    content = df.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batch):
        v, texts = _vocabulary(content.value), [t or "" for t in batch.column(1).to_pylist()]
        for i, j in _runs(texts):
            ids = v.encode(texts[i:j])
            first = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(first, pa.array(flat, pa.int32()))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return map_blocks(df.select(key, text), f"key {kind}, ids array<int>", run).withColumnRenamed("key", key)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` of every row of ids; null ids read as none."""
    content = df.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batch):
        v = _vocabulary(content.value)
        texts = [v.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return map_blocks(df.select(key, ids), f"key {kind}, text string", run).withColumnRenamed("key", key)


def token_digests(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode every text: number of ids, hash of the ids, hash of the decoded text."""
    content = df.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batch):
        v, texts = _vocabulary(content.value), [t or "" for t in batch.column(1).to_pylist()]
        for i, j in _runs(texts):
            ids = v.encode(texts[i:j])
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[i:j], pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids])],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return map_blocks(df.select(key, text), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", run).withColumnRenamed("key", key)


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def with_tokens(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """All rows and columns of ``df``, the text as decoded from its ids, with ``ids`` and ``n_tokens``; repeated rows stay apart."""
    content = df.sparkSession.sparkContext.broadcast(_read(vocabulary))
    df = df.drop("ids", "n_tokens")
    place, names = df.columns.index(text), [*df.columns, "ids", "n_tokens"]

    def run(batch):
        v, texts = _vocabulary(content.value), [t or "" for t in batch.column(place).to_pylist()]
        for i, j in _runs(texts):
            ids = v.encode(texts[i:j])
            size = np.array([len(x) for x in ids])
            columns = list(batch.slice(i, j - i).columns)
            columns[place] = pa.array([v.decode(x) for x in ids], pa.string())
            flat = pa.array(np.concatenate(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), flat), pa.array(size, pa.int64())], names)

    return map_blocks(df, extended(df, "ids array<int>, n_tokens long"), run)
