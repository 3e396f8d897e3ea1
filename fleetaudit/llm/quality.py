"""Quality by hierarchical empirical Bayes: document evidence with host and path posteriors.

1. A logistic classifier on simple text features gives each document a probability of good quality.
   It is fitted by Newton steps on a bounded sample of different labelled rows; only features reach the driver.
2. Hosts and paths gather the evidence of their documents (the label where there is one, else the
   probability) by grouped sums. A host's rate shrinks toward the global rate, a path's toward its
   host's, each by a strength estimated from the spread between sites by moments: sparse sites stay
   near their prior.
3. The document's odds are its own times the path's rate over the global rate.

A null host or path is a site of its own. Null and empty texts have zero features. Without labelled
rows of both kinds every probability is one half and all is kept. Several labels of one key count as
their mean; repeated rows count as often as they occur in the rates and once in the fit.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stage import staged
from .text import U64, Words, blocks, map_blocks, sums_by, text_bytes

FEATURES = ("length", "upper", "digit", "mark", "point", "line", "wide", "word", "distinct", "high")


@dataclass(frozen=True)
class Settings:
    max_rows: int = 20_000  # different labelled rows in the fit, those with the smallest hash of key and features
    steps: int = 25
    ridge: float = 1.0
    keep_from: float = 0.5


def _table(values: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(values)] = 1
    return t


_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT = _table(bytes(range(48, 58)))
_POINT = _table(b".,;:'\"()-?")
_MARK = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"))
_LINE = _table(b"\n")
_HIGH = _table(bytes(range(128, 256)))


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of features per document of a block."""
    size = np.maximum(np.diff(offsets), 1)
    def share(table):
        return sums_by(table[data], offsets)
    words = Words(offsets, data)
    count = np.diff(words.first)
    order = np.unique((words.hashes >> U64(10)) | (words.doc.astype(U64) << U64(54)))
    distinct = np.bincount((order >> U64(54)).astype(np.int64), minlength=len(size))
    out = [np.log1p(np.diff(offsets)) / 10, share(_UPPER) / np.maximum(share(_LETTER), 1), share(_DIGIT) / size, np.sqrt(share(_MARK) / size),
           share(_POINT) / size, share(_LINE) / size, np.minimum(sums_by(words.ends - words.starts, words.first) / np.maximum(count, 1), 40) / 10,
           np.log1p(count) / 10, distinct / np.maximum(count, 1), share(_HIGH) / size]
    return np.stack(out, axis=1)


def _design(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)


def fit(x: np.ndarray, y: np.ndarray, how: Settings = Settings()) -> np.ndarray:
    """Weights of the intercept, the features and their squares."""
    d = _design(x)
    w = np.zeros(d.shape[1])
    for _ in range(how.steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (y - p) - how.ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d + how.ridge * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    return w


def _strength(mean: float, spread: float) -> float:
    """Pseudo-count of a beta prior with this mean and variance between sites, within wide limits."""
    return float(min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 1.0), 1e6))


def _features(df: DataFrame, place: int) -> DataFrame:
    def run(batch):
        offsets, data = text_bytes(batch.column(place))
        for i, j in blocks(offsets):
            f = features(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], batch.column(2)[i:j], flat], ["key", "host", "path", "features"])
    return map_blocks(df, f"key {df.schema['key'].dataType.simpleString()}, host string, path string, features array<double>", run)


def _sample(rows: DataFrame, most: int) -> list:
    """The different rows of smallest ``order``, ``most`` at the most.

    One count tells the share of hash values that holds a quarter more than ``most`` rows; only rows of that share
    are sorted, so what the tasks send does not grow with their number. Where rows repeat, fewer may remain.
    """
    share = 1.25 * most / max(rows.count(), 1)
    if share < 1:
        rows = rows.where(F.col("order") <= F.lit(int(share * (1 << 64)) - (1 << 63)))
    return rows.groupBy("order", "key", "features", "label").count().orderBy("order", "key", "features").limit(most).collect()


def score(df: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text",
          label: str = "quality", how: Settings = Settings()) -> DataFrame:
    """Per row of ``df``: key, evidence, host_rate, path_rate, score, keep.

    The features are computed once and written to the shared folder, so the texts are read once and
    never shuffled. Spreads come from grouped sums; four numbers reach the driver.
    """
    rows = df.select(F.col(key).alias("key"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    marked = staged(_features(rows, 3).join(known, "key", "left"), "quality-features")
    sample = _sample(marked.where("label is not null").select(F.xxhash64("key", "features").alias("order"), "key", "features", "label"), how.max_rows)
    y = np.array([r["label"] for r in sample])
    weights = fit(np.array([r["features"] for r in sample]), y, how) if len(y) and y.min() < 0.5 <= y.max() else np.zeros(1 + 2 * len(FEATURES))

    logit = F.lit(float(weights[0]))
    for i in range(len(FEATURES)):
        f = F.col("features")[i]
        logit = logit + F.lit(float(weights[1 + i])) * f + F.lit(float(weights[1 + len(FEATURES) + i])) * f * f
    logit = F.least(F.greatest(logit, F.lit(-12.0)), F.lit(12.0))
    scored = marked.select("key", "host", "path", (1 / (1 + F.exp(-logit))).alias("own"), "label").withColumn("evidence", F.coalesce("label", "own"))

    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.count("*").alias("host_paths"))
    whole = hosts.agg(F.sum("host_n"), F.sum("host_s"), F.count("*")).first()
    total, good, sites = whole[0] or 0, whole[1] or 0.0, whole[2]
    mean = min(max((good + 0.5) / (total + 1), 1e-6), 1 - 1e-6)
    within = mean * (1 - mean)
    # Variance of site means beyond what their sizes explain.
    between = hosts.agg(F.sum(F.pow(F.col("host_s") / F.col("host_n") - mean, F.lit(2)) - within / F.col("host_n"))).first()[0] or 0.0
    host_k = _strength(mean, max(between, 0.0) / max(sites - 1, 1))
    hosts = hosts.withColumn("host_rate", (F.lit(host_k * mean) + F.col("host_s")) / (F.lit(host_k) + F.col("host_n")))
    tree = paths.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).drop("of")
    inner = tree.agg(F.sum(F.pow(F.col("s") / F.col("n") - F.col("host_rate"), F.lit(2)) - F.col("host_rate") * (1 - F.col("host_rate")) / F.col("n")), F.count("*")).first()
    path_k = _strength(mean, max(inner[0] or 0.0, 0.0) / max(inner[1], 1))
    rates = tree.select(F.col("host").alias("in_host"), F.col("path").alias("in_path"), "host_rate",
                        ((F.lit(path_k) * F.col("host_rate") + F.col("s")) / (F.lit(path_k) + F.col("n"))).alias("path_rate"))
    odds = F.log(F.col("own") / (1 - F.col("own"))) + F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - F.lit(float(np.log(mean / (1 - mean))))
    out = scored.join(rates, F.col("host").eqNullSafe(F.col("in_host")) & F.col("path").eqNullSafe(F.col("in_path")))
    quality = 1 / (1 + F.exp(-odds))
    return out.select(F.col("key").alias(key), F.col("own").alias("evidence"), "host_rate", "path_rate", quality.alias("score"), (quality >= how.keep_from).alias("keep"))
