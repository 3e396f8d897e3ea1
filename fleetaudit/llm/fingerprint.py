"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph is hashed to a wide vector; a document's state is the sum of its paragraphs' vectors,
lane by lane, modulo 2**32. The order of paragraphs does not matter, and paragraphs can be inserted
or deleted by adding or subtracting their vectors (``insert``, ``delete``).

The first ``EXACT`` lanes take random values and decide equality. The last ``SIGNED`` lanes take
plus or minus the root of the paragraph's length, so the squared distance of two states estimates how
many letters lie in paragraphs that only one text has; this gives the likeness.

Paragraphs are lines; lines over ``LONG`` letters are cut after sentences. Null reads as empty; an
empty text has no paragraph and the zero state. Very long texts take memory for themselves only.
Equal texts have equal states; texts with the same paragraphs in another order too. Repeated rows
and extra columns do no harm.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import extended, map_blocks

EXACT = 64
SIGNED = 512
LONG = 240
_SENTENCE = re.compile(r"(?<=[.!?]) ")
_BYTES = EXACT * 4 + SIGNED // 8


def paragraphs(text: str | None) -> list[str]:
    """Units of a text; joining lines again gives the text."""
    out = []
    for line in text.split("\n") if text else []:
        out += _SENTENCE.split(line) if len(line) > LONG else [line]
    return out


def vectors(units: list[str]) -> np.ndarray:
    """State that the units add up to."""
    if not units:
        return np.zeros(EXACT + SIGNED, np.uint32)
    raw = [u.encode() for u in units]
    drawn = np.frombuffer(b"".join(hashlib.shake_128(u).digest(_BYTES) for u in raw), np.uint8).reshape(len(raw), _BYTES)
    exact = np.ascontiguousarray(drawn[:, :EXACT * 4]).view("<u4").sum(axis=0, dtype=np.uint32)
    weight = np.round(np.sqrt([len(u) + 1 for u in raw]))
    plus = weight @ np.unpackbits(drawn[:, EXACT * 4:], axis=1)
    signed = (2 * plus - weight.sum()).astype(np.int64).astype(np.uint32)
    return np.concatenate([exact, signed])


def state(text: str | None) -> np.ndarray:
    return vectors(paragraphs(text))


def insert(s: np.ndarray, units: list[str]) -> np.ndarray:
    """State with these paragraphs added."""
    return s + vectors(units)


def delete(s: np.ndarray, units: list[str]) -> np.ndarray:
    """State with these paragraphs taken away."""
    return s - vectors(units)


def digest(s: np.ndarray) -> str:
    """Short form of a state for comparison and transport."""
    return hashlib.blake2b(s.astype("<u4").tobytes(), digest_size=32).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common paragraphs by letters: 1 for equal states, about 0 for none."""
    if (a == b).all():
        return 1.0
    x, y = (s[EXACT:].view(np.int32).astype(np.float64) for s in (a, b))
    total = x @ x + y @ y
    apart = (a[EXACT:] - b[EXACT:]).view(np.int32).astype(np.float64)
    return float(min(1.0, max(0.0, 1 - apart @ apart / total))) if total else 0.0


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns and rows of ``df`` with ``state`` (binary, for inserting and deleting) and ``fingerprint``."""
    df = df.drop("state", "fingerprint")
    place = df.columns.index(text)

    def run(batch):
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            states = [state(t) for t in part.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([s.astype("<u4").tobytes() for s in states]), pa.array([digest(s) for s in states])],
                                             [*batch.schema.names, "state", "fingerprint"])

    return map_blocks(df, extended(df, "state binary, fingerprint string"), run)


def in_chains(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows dealt into ranges of the key, each range followed by the first row of the next one.

    The order is descending, nulls last; the row after the last is the first. Columns ``chain`` and
    ``extra`` tell the range and whether the row only closes it. Bounds and first keys, a few numbers
    per range, are all that reaches the driver. The texts are shuffled once.
    """
    bounds = sorted({int(b) for b in df.select(key).dropna().approxQuantile(key, [i / parts for i in range(1, parts)], 0.1 / parts) or []}) if parts > 1 else []
    chain = F.when(F.col(key).isNull(), 0).otherwise(1 + F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b <= F.col(key))))
    placed = df.withColumn("chain", chain)
    heads = sorted(placed.groupBy("chain").agg(F.max(key).alias("head")).collect(), key=lambda r: r["chain"])
    if not heads:
        return placed.withColumn("extra", F.lit(False))
    # The first row of each chain closes the chain before it, which holds the larger keys.
    target = {r["chain"]: heads[(i + 1) % len(heads)]["chain"] for i, r in enumerate(heads)}
    first = F.create_map(*[x for r in heads for x in (F.lit(r["chain"]), F.lit(r["head"]).cast("bigint"))])
    close = F.create_map(*[F.lit(x) for k, v in target.items() for x in (k, v)])
    own = F.struct(F.col("chain"), F.lit(False).alias("extra"))
    also = F.struct(F.element_at(close, F.col("chain")).alias("chain"), F.lit(True).alias("extra"))
    is_head = F.col(key).eqNullSafe(F.element_at(first, F.col("chain")))
    dealt = placed.withColumn("to", F.explode(F.when(is_head, F.array(own, also)).otherwise(F.array(own))))
    dealt = dealt.select(*df.columns, F.col("to.chain").alias("chain"), F.col("to.extra").alias("extra"))
    return dealt.repartition("chain").sortWithinPartitions("chain", "extra", F.col(key).desc_nulls_last(), "text")


def _pair(row: dict, after: dict) -> tuple:
    text, n = row["text"], len(row["text"])
    edited = text[:n - n // 2] + after["text"][:n // 2]
    changed = state(edited)
    return (row["key"], n, hashlib.sha256(edited.encode()).hexdigest(), digest(row["state"]), digest(changed),
            likeness(row["state"], changed), likeness(row["state"], after["state"]))


PAIR_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")


def edits(df: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each text against its edit: the last half replaced by as much of the next text.

    The next text is that of the next smaller key; after the last comes the first. Rows of one key
    follow each other by text. Null keys come last. A single row is followed by itself.
    """
    spark = df.sparkSession
    parts = parts or min(512, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = [f.split()[0] for f in PAIR_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        last, out = None, []

        def flush():
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
            return done

        for batch in batches:
            for i in range(batch.num_rows):
                key, text, chain, extra = (batch.column(c)[i].as_py() for c in range(4))
                row = {"key": key, "text": text, "chain": chain, "state": state(text)}
                if last is not None and last["chain"] == chain:
                    out.append(_pair(last, row))
                last = None if extra else row
                if len(out) >= 512:
                    yield flush()
        if out:
            yield flush()

    return in_chains(rows, "key", parts).select("key", "text", "chain", "extra").mapInArrow(run, PAIR_SCHEMA)
