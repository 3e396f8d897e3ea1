"""Byte-level BPE from a rank file, encoded by the tokenizers library over Arrow batches, with offsets.

A rank file lists byte strings by rank. The byte table gives every byte a printed character, so that
the ranks become a vocabulary of character strings; the merge behind a rank is the pair of parts that
the lower ranks leave of its bytes. The library splits a text by the pattern, maps bytes to
characters, merges, and gives ids with the code points each came from. A token may hold part of a
character only; its offsets then cover the whole character. Decoding goes from ids through the byte
table back to bytes; a character that several tokens share is read when its last byte has come.

Texts are handled whole. Texts of over ``SEGMENT`` letters are encoded in segments, cut before a
space that follows a letter or digit, where every split pattern of this family ends a match; this
bounds memory and changes no id. Where no offsets are asked for, texts are cut before every space that
follows no white space, since no match goes on there either, and each different piece of a batch is
encoded once; a worker keeps the ids of short pieces. Null reads as empty, empty texts give no ids, equal texts give equal
ids, repeated rows stay rows of their own, null keys stay null, empty tables give empty results.
Extra columns are ignored. Special tokens do not exist: their letters are ordinary text. Bytes that
are no UTF-8 decode to replacement characters in ``text`` and stay as they are in ``bytes``.
"""
from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import PRINTED
from .text import map_blocks, ragged

SEGMENT = 1 << 18
CUT = re.compile(r"(?<=\w) ")
AFTER_SPACE = re.compile(r"\s ")
PIECES = re.compile(r"(?<=\S) ")
KEPT = 1 << 19  # pieces whose ids a worker keeps, then it starts anew; this changes speed only
KEPT_LETTERS = 64  # in a piece that is kept


def byte_characters() -> list[str]:
    """The printed character of each byte; bytes without one take the code points from 256 on, in order."""
    printed = set(PRINTED)
    hidden = iter(range(256, 512))
    return [chr(b) if b in printed else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each byte string of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def parents(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the ranks below ``rank`` leave of a token."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= rank:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    if len(parts) != 2:
        raise ValueError(f"rank {rank} is no merge of two lower ranks")
    return parts[0], parts[1]


def specification(ranks: dict[bytes, int], pattern: str) -> str:
    """The tokenizer of the library, as JSON, that encodes each match of ``pattern`` by the ranks."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"bytes without a rank: {missing}")
    shown = byte_characters()

    def characters(token: bytes) -> str:
        return "".join(shown[b] for b in token)

    merges = [tuple(map(characters, parents(t, r, ranks))) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    # A match that is a token itself is that token, as the ranks have it.
    tokenizer = Tokenizer(models.BPE(vocab={characters(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


class Codec:
    """Encoder and decoder of one specification; one per Python worker."""

    def __init__(self, specification: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the cores
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(specification)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = json.loads(specification)["model"]["vocab"]
        pieces = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            pieces[i] = bytes(byte_of[c] for c in token)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.kept: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        # All pieces but the first of a text begin with the space that is left out here.
        cut = [PIECES.split(text) if AFTER_SPACE.search(text) else text.split(" ") for text in texts]
        opening = [pieces.pop(0) for pieces in cut]
        if len(self.kept) >= KEPT:
            self.kept.clear()
        new = set().union(*cut).difference(self.kept)
        known = self._pieces([" " + p for p in new] + opening)
        self.kept |= {p: known[" " + p] for p in new if len(p) < KEPT_LETTERS}
        long = {p: known[" " + p] for p in new if len(p) >= KEPT_LETTERS}
        kept = self.kept
        return [known[first] + b"".join([long[p] if p in long else kept[p] for p in pieces] if long else map(kept.__getitem__, pieces))
                for first, pieces in zip(opening, cut)]

    def _pieces(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of each different text, encoded in batches of about ``SEGMENT`` letters."""
        known, batch, total = {}, [], 0
        for text in dict.fromkeys(texts):
            batch.append(text)
            total += len(text)
            if total >= SEGMENT:
                known |= self._encoded(batch)
                batch, total = [], 0
        return known | self._encoded(batch)

    def _encoded(self, batch: list[str]) -> dict[str, bytes]:
        return {p: struct.pack(f"<{len(x)}I", *x.ids) for p, x in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))}

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text, and the first and the end code point of each id."""
        out: list[list] = [[] for _ in texts]
        batch: list[tuple[int, int, str]] = []
        total = 0
        for i, at, segment in _segments(texts):
            batch.append((i, at, segment))
            total += len(segment)
            if total >= SEGMENT:
                self._encode(batch, out)
                batch, total = [], 0
        self._encode(batch, out)
        return [tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int64), np.zeros((0, 2), np.int64)) for parts in out]

    def _encode(self, batch: list[tuple[int, int, str]], out: list[list]) -> None:
        for (i, at, _), found in zip(batch, self.tokenizer.encode_batch([s for _, _, s in batch], add_special_tokens=False)):
            spans = np.array(found.offsets, np.int64).reshape(-1, 2) + at
            out[i].append((np.array(found.ids, np.int64), spans))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids."""
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()

    def pieces(self, ids: np.ndarray) -> list[str]:
        """Text of each id; a character over several ids comes with the last of them, and all pieces make the text."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = [decoder.decode(self.bytes[self.starts[i]:self.starts[i] + self.lengths[i]].tobytes()) for i in ids]
        if out:
            out[-1] += decoder.decode(b"", True)
        return out


def _segments(texts: list[str]) -> Iterator[tuple[int, int, str]]:
    """Number of the text, first letter and letters of each segment."""
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > SEGMENT:
            cut = CUT.search(text, at + SEGMENT)
            if cut is None:
                break
            yield i, at, text[at:cut.start()]
            at = cut.start()
        if at < len(text):
            yield i, at, text[at:] if at else text


@cache
def _codec(specification: str) -> Codec:
    return Codec(specification)


def _shared(df: DataFrame, path: str, pattern: str):
    """The specification, made once from the file, for every task; its size is that of the vocabulary."""
    return df.sparkSession.sparkContext.broadcast(specification(read_ranks(path), pattern))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Texts of a batch in ranges of about 4 ``SEGMENT`` letters."""
    texts, i, total = [], 0, 0
    for j in range(len(column)):
        texts.append(column[j].as_py() or "")
        total += len(texts[-1])
        if total >= 4 * SEGMENT:
            yield i, j + 1, texts
            texts, i, total = [], j + 1, 0
    if texts:
        yield i, len(column), texts


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids``, ``starts`` and ``ends`` of every text: the code points that each id comes from. One scan, no shuffle."""
    shared = _shared(df, path, pattern)

    def run(batch):
        for i, j, texts in _texts(batch.column(1)):
            found = _codec(shared.value).encode(texts)
            first = pa.array(np.append(0, np.cumsum([len(x) for x, _ in found])), pa.int32())
            ids, spans = np.concatenate([x for x, _ in found]), np.concatenate([s for _, s in found])
            arrays = [pa.ListArray.from_arrays(first, pa.array(values, pa.int32())) for values in (ids, spans[:, 0], spans[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *arrays], ["key", "ids", "starts", "ends"])

    kind = df.schema[key].dataType.simpleString()
    return map_blocks(df.select(key, text), f"key {kind}, ids array<int>, starts array<int>, ends array<int>", run).withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key``, ``bytes``, ``text`` and ``pieces`` (the text of each id) of every row of ids; null ids read as none."""
    shared = _shared(df, path, pattern)

    def run(batch):
        codec, whole, pieces = _codec(shared.value), [], []
        for x in batch.column(1).to_pylist():
            x = np.array(x or [], np.int64)
            whole.append(codec.decode(x))
            pieces.append(codec.pieces(x))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(whole, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in whole], pa.string()),
            pa.array(pieces, pa.list_(pa.string()))], ["key", "bytes", "text", "pieces"])

    kind = df.schema[key].dataType.simpleString()
    return map_blocks(df.select(key, ids), f"key {kind}, bytes binary, text string, pieces array<string>", run).withColumnRenamed("key", key)


def token_digests(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every text and decode its ids: number of ids, hash of the ids, hash of the decoded bytes. One scan, no shuffle."""
    shared = _shared(df, path, pattern)

    def run(batch):
        codec = _codec(shared.value)
        for i, j, texts in _texts(batch.column(1)):
            ids = codec.ids(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[i:j], pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(codec.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in ids])],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return map_blocks(df.select(key, text), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", run).withColumnRenamed("key", key)
