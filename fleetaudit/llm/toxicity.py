"""Toxicity: subword embeddings averaged into a linear softmax, trained jointly in numpy.

A text's units are its words and their n-grams of 3 to 5 bytes, borders included, so a misspelling
that was never seen still shares most of its n-grams. Each unit has an embedding (by hash); a text
is their mean; a linear softmax tells the classes apart. Embeddings and softmax are fitted together
by Adam on a bounded sample of labelled rows.

As the layers are linear, a unit's contribution to the logit is one number. Scoring sums these
numbers over a text, in blocks of documents.

ASCII letters count in lower case, other ASCII characters but digits separate words. A word
repeated within a text counts once there. Null and empty texts have no unit; their score is the
softmax of the bias alone. With no labelled row the score lies just below 0.5, so nothing is predicted
toxic; with labels of one class only it is that class's share. Repeated rows count as often as they occur.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, Substrings, blocks, extended, map_blocks, text_bytes

SIZES = (3, 4, 5)
_FOLD = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = _b
_FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Training:
    """Sizes and bounds of the fit."""

    max_rows: int = 10_000  # labelled rows in the sample, those with the smallest hash of the key
    buckets: int = 1 << 14
    width: int = 8
    padding: int = 400  # empty units added to each text, so that a few words alone decide little
    epochs: int = 8
    batch: int = 256
    rate: float = 0.3
    decay: float = 0.01
    seed: int = 11


def units(offsets: np.ndarray, data: np.ndarray):
    """Hash and document of each unit of a block, one array per size: words first, then n-grams."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    row = np.full(len(data) + n + 1, 32, np.uint8)
    row[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), lengths)] = _FOLD[data]
    starts = offsets + np.arange(n + 1)  # the border before each document; the last one closes the block
    space = row == 32
    gaps = np.flatnonzero(space)
    text = Substrings(row)
    wide = np.flatnonzero(np.diff(gaps) > 1)
    opens, closes = gaps[wide], gaps[wide + 1]
    words, doc = text.hash(opens, closes + 1), np.searchsorted(starts, opens, "right") - 1
    # Each word of a document counts once, however often it is repeated.
    _, once = np.unique((words >> U64(10)) | (doc.astype(U64) << U64(54)), return_index=True)
    opens, closes = opens[once], closes[once]
    yield words[once], doc[once]
    edge = np.zeros(len(row) + 1, np.int8)
    edge[opens] += 1
    edge[closes] -= 1
    counted = np.cumsum(edge[:-1], dtype=np.int8) > 0
    # The next separator after each place tells whether a separator lies within.
    following = np.append(gaps, len(row))[np.cumsum(space)]
    for size in SIZES:
        if len(row) < size:
            continue
        at = np.flatnonzero(counted[:len(row) - size + 1] & (following[:len(row) - size + 1] >= np.arange(size - 1, len(row))))
        if len(at):
            yield text.hash(at, at + size) + U64(size), np.searchsorted(starts, at, "right") - 1


def _shares(text: str | None, how: Training) -> np.ndarray:
    """Share of each bucket among the units of a text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    total = np.zeros(how.buckets)
    for hashes, _ in units(np.array([0, len(raw)]), raw):
        total += np.bincount((hashes % U64(how.buckets)).astype(np.int64), minlength=how.buckets)
    return total / (total.sum() + how.padding) * np.sqrt(how.buckets)


def fit(texts: list[str | None], labels: list[int], how: Training) -> tuple[np.ndarray, float]:
    """Logit of each bucket and the bias."""
    rng = np.random.default_rng(how.seed)
    x = np.zeros((len(texts), how.buckets), np.float16)
    for i, t in enumerate(texts):
        x[i] = _shares(t, how)
    y = np.array(labels, np.float32)
    target = np.stack([1 - y, y], axis=1)
    params = [rng.normal(0, 0.1, (how.buckets, how.width)).astype(np.float32), rng.normal(0, 0.5, (how.width, 2)).astype(np.float32), np.zeros(2, np.float32)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    batch = min(how.batch, len(y))
    steps = how.epochs * (len(y) // batch)
    for step in range(1, steps + 1):
        if (step - 1) % (len(y) // batch) == 0:
            order = rng.permutation(len(y))
        at = order[(step - 1) % (len(y) // batch) * batch:][:batch]
        e, w, b = params
        xs = x[at].astype(np.float32)
        hidden = xs @ e
        logits = hidden @ w + b
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target[at]) / batch
        rate = how.rate * (1 - step / (steps + 1))
        for k, grad in enumerate((xs.T @ (g @ w.T), hidden.T @ g, g.sum(axis=0))):
            mean[k] += 0.1 * (grad - mean[k])
            square[k] += 0.01 * (grad * grad - square[k])
            move = rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
            params[k] -= (move if k == 0 else 0.1 * move).astype(np.float32)
        params[0] *= np.float32(1 - rate * how.decay)
    e, w, b = (p.astype(np.float64) for p in params)
    return np.sqrt(how.buckets) * (e @ (w[:, 1] - w[:, 0])), float(b[1] - b[0])


def score_block(offsets: np.ndarray, data: np.ndarray, logit: np.ndarray, bias: float, padding: int = Training.padding) -> np.ndarray:
    n = len(offsets) - 1
    total, count = np.zeros(n), np.zeros(n)
    for hashes, doc in units(offsets, data):
        total += np.bincount(doc, logit[(hashes % U64(len(logit))).astype(np.int64)], minlength=n)
        count += np.bincount(doc, minlength=n)
    return 1 / (1 + np.exp(-np.clip(bias + total / (count + padding), -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, how: Training = Training(), key: str = "doc_id", text: str = "text", label: str = "label") -> DataFrame:
    """Texts of the bounded sample: the labelled rows with the smallest hash of the key, joined to their texts.

    The labels are cut down before the join, so only their texts are looked up.
    """
    chosen = (labels.where(F.col(label).isin(0, 1)).select(F.xxhash64(F.col(key)).alias("order"), F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
              .orderBy("order", "key", "label").limit(how.max_rows))
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("key", "text", "label")


def train(chosen: DataFrame, how: Training = Training()) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample (``key``, ``text``, ``label``) in one task; the model (``buckets`` numbers) comes to the driver."""
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "text", "label").limit(2 * how.max_rows)

    def run(batches):
        texts, labels = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
        if not labels:
            return
        if len(set(labels)) < 2:
            share = (sum(labels) + 0.5) / (len(labels) + 1.01)
            logit, bias = np.zeros(how.buckets), float(np.log(share / (1 - share)))
        else:
            logit, bias = fit(texts, labels, how)
        yield pa.RecordBatch.from_arrays([pa.array([logit.tolist()], pa.list_(pa.float64())), pa.array([bias])], ["logit", "bias"])

    rows = chosen.select("text", "label").coalesce(1).mapInArrow(run, "logit array<double>, bias double").collect()
    return (np.array(rows[0]["logit"]), rows[0]["bias"]) if rows else (np.zeros(how.buckets), -0.01)


def score(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """All columns and rows of ``df`` with ``score`` (0 to 1) and ``predicted``; nothing but the text decides."""
    logit, bias = df.sparkSession.sparkContext.broadcast(model[0]), model[1]
    df = df.drop("score", "predicted")
    place = df.columns.index(text)

    def run(batch):
        offsets, data = text_bytes(batch.column(place))
        parts = [score_block(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]], logit.value, bias) for i, j in blocks(offsets)]
        found = np.concatenate(parts)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                                         [*batch.schema.names, "score", "predicted"])

    return map_blocks(df, extended(df, "score double, predicted int"), run)
