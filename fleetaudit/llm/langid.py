"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds its letters' vectors, each rotated by
its place, by multiplication; a document bundles (adds) its trigrams; a language's prototype bundles
its documents. A document goes to the prototype of largest cosine. Trigrams are counted per block of
documents first, so that a block costs few matrix products.

Prototypes are sums, kept per task and added up by Spark: as many numbers as languages times
``DIMENSIONS`` reach the driver, whatever the number of documents.

Null texts and texts without a letter get ``und`` with score 0. A single letter already makes a
trigram with the word's borders. Ties go to the smaller name. With nothing to learn from, every text
gets ``und``. Rows with a null language teach nothing; repeated rows count as often as they occur.
"""
from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blocks, extended, map_blocks, sums_by, text_bytes

DIMENSIONS = 512
CLASSES = 128  # letters: a to z, Latin letters of two bytes, all others by remainder
DOCUMENTS, TRIGRAMS = 64, 1 << 10  # counted, and made vectors of, at a time
UNDETERMINED = "und"
SHARPNESS = 20.0  # of the score: softmax of so many times the cosines


@cache
def _classes() -> np.ndarray:
    """Class of each code point, in lower case; 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low - 0xDF if 0xDF <= low <= 0xFF else 60 + low % 68
    return table


@cache
def _letters() -> tuple[np.ndarray, ...]:
    """Letter vectors, rotated by two, one and no places."""
    base = np.random.default_rng(20240601).integers(0, 2, (CLASSES, DIMENSIONS), np.int8) * 2 - 1
    return tuple(np.roll(base, turn, axis=1).astype(np.float32) for turn in (2, 1, 0))


def profiles(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vector of each document of a block, and whether it has a letter."""
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    leads = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    kinds = _classes()[points]
    has = sums_by((kinds > 0).astype(np.int64), leads) > 0
    # A border before, between and after documents.
    row = np.zeros(len(kinds) + n + 1, np.int64)
    lengths = np.diff(leads)
    place = np.arange(len(kinds)) + np.repeat(np.arange(1, n + 1), lengths)
    row[place] = kinds
    owner = np.repeat(np.arange(n), lengths + 1)
    owner = np.append(owner, n - 1)
    middle = row[1:-1] > 0
    code = ((row[:-2] * CLASSES + row[1:-1]) * CLASSES + row[2:])[middle]
    doc = owner[1:-1][middle]
    seen = np.zeros(CLASSES ** 3, bool)
    seen[code] = True
    grams = np.flatnonzero(seen)
    number = np.zeros(CLASSES ** 3, np.int32)
    number[grams] = np.arange(len(grams))
    which = number[code]
    del owner, place, row, middle, code, seen, number, points, kinds
    # Counts of some documents at a time, vectors of some trigrams: whole numbers, so their sums do not depend on the cut.
    counts = np.empty((n, len(grams)), np.float32)
    for i in range(0, n, DOCUMENTS):
        j = min(i + DOCUMENTS, n)
        lo, hi = np.searchsorted(doc, (i, j))
        counts[i:j] = np.bincount((doc[lo:hi] - i) * len(grams) + which[lo:hi], minlength=(j - i) * len(grams)).reshape(j - i, len(grams))
    a, b, c = _letters()
    total = np.zeros((n, DIMENSIONS), np.float32)
    for i in range(0, len(grams), TRIGRAMS):
        part = grams[i:i + TRIGRAMS]
        vectors = a[part // CLASSES ** 2] * b[part // CLASSES % CLASSES]
        vectors *= c[part % CLASSES]
        total += counts[:, i:i + TRIGRAMS] @ vectors
    return total, has


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language from all rows that name one."""
    def run(batch):
        offsets, data = text_bytes(batch.column(0))
        names = np.array(batch.column(1).to_pylist(), object)
        for i, j in blocks(offsets, rows=256):
            cut = offsets[i:j + 1] - offsets[i]
            vectors, _ = profiles(cut, data[offsets[i]:offsets[j]])
            for name in sorted(set(names[i:j])):
                total = vectors[names[i:j] == name].astype(np.int64).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["lang", "part"])

    known = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    parts = map_blocks(known, "lang string, part array<long>", run)
    sums = parts.select("lang", F.posexplode("part").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")).collect()
    return {r["lang"]: np.array([x["value"] for x in r["v"]], np.float64) for r in sorted(rows, key=lambda r: r["lang"])}


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def classify(texts: pa.Array, names: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    offsets, data = text_bytes(texts)
    out, score = [], np.zeros(len(texts))
    for i, j in blocks(offsets, rows=256):
        vectors, has = profiles(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]])
        if not names:
            out += [UNDETERMINED] * (j - i)
            continue
        cosine = _unit(vectors.astype(np.float64)) @ prototypes.T
        weight = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
        best = cosine.argmax(axis=1)
        score[i:j] = np.where(has, 1 / weight.sum(axis=1), 0)
        out += [names[b] if h else UNDETERMINED for b, h in zip(best, has)]
    return out, score


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """All columns and rows of ``df`` with ``lang_pred`` and ``score``; nothing but the text decides."""
    names = sorted(prototypes)
    model = df.sparkSession.sparkContext.broadcast(_unit(np.array([prototypes[n] for n in names])) if names else np.zeros((0, DIMENSIONS)))
    df = df.drop("lang_pred", "score")
    place = df.columns.index(text)

    def run(batch):
        found, score = classify(batch.column(place), names, model.value)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return map_blocks(df, extended(df, "lang_pred string, score double"), run)


def in_fold(key: str, folds: int, fold: int) -> Column:
    """Whether the checksum of the key as text leaves this remainder; a null key never does."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def drop_unknown(df: DataFrame, least: float = 0.3, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` without texts that have no letter, are null, or fit no learned language better than ``least``.

    With nothing to learn from, only the first two go.
    """
    prototypes = learn(df, text, lang)
    if not prototypes:
        return df.where(F.col(text).rlike(r"\p{L}"))
    names = df.columns
    scored = predict(df.toDF(*[f"own_{n}" for n in names]), prototypes, f"own_{text}")
    return scored.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*[F.col(f"own_{n}").alias(n) for n in names])
