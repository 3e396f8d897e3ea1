"""What the two operators on repeated passages share: anchors, their groups, and applying spans to texts.

A text is a sequence of units (words or bytes). Each window of fixed length picks an anchor, a place
inside it that depends on the window's units alone, so equal windows pick the same place. Windows
next to each other that share an anchor form a group; the units under them are the group's context.
A window can only repeat where its anchor's key repeats. That leaves few groups; equal contexts
settle whole groups at once, and only contexts that differ under one key go on to a closer look.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import staged
from .text import U64, Substrings, blocks, map_blocks, sliding_min, text_bytes

DOC = "doc struct<id: bigint, row: bigint>"
ANCHORS = f"{DOC}, start long, windows int, key long, context long"
# Bits of the filter that spares untouched documents a shuffle; its table has this many / 64 rows at most.
FILTER_BITS = 1 << 23
LAST = (1 << 63) - 1  # stands for a null id, after all others


def order_keys(hashes: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Hashes whose low bits give way to the place, so that a minimum names the leftmost smallest one; and the bits."""
    bits = max(20, int(length).bit_length())
    return (hashes >> U64(bits) << U64(bits)) | np.arange(length, dtype=U64), bits


def groups(keys: np.ndarray, bits: int, first: np.ndarray, window: int, footprint: int, text: Substrings, second: Substrings):
    """Window groups of a block: document, start (within it), number of windows, key, context.

    ``keys``: order key of each place that can be an anchor, the largest value elsewhere. ``footprint``
    is how many units an anchor depends on. Windows without any anchor stand alone under the hash of
    their own units.
    """
    n = len(keys)
    lengths = np.diff(first)
    if n < window or lengths.max(initial=0) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    best = sliding_min(keys, window - footprint + 1)[:n - window + 1]
    doc = np.repeat(np.arange(len(lengths)), lengths)[:n - window + 1]
    inside = np.arange(n - window + 1) + window <= first[1:][doc]
    at, best, doc = np.flatnonzero(inside), best[inside], doc[inside]
    alone = best == U64(0xFFFFFFFFFFFFFFFF)
    place = (best & U64((1 << bits) - 1)).astype(np.int64)
    opens = np.append(True, (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]) | alone[1:])
    opens = np.flatnonzero(opens)
    count = np.diff(np.append(opens, len(at)))
    start, doc, alone, place = at[opens], doc[opens], alone[opens], place[opens]
    key = np.empty(len(opens), U64)
    key[~alone] = text.hash(place[~alone], place[~alone] + footprint)
    key[alone] = ~text.hash(start[alone], start[alone] + window)
    context = second.hash(start, start + count - 1 + window)
    return doc, start - first[doc], count, key.view(np.int64), context.view(np.int64)


def anchors(df: DataFrame, of_block: Callable) -> DataFrame:
    """Rows of ``ANCHORS`` for the documents (id, text); ``of_block`` gives the groups of a block."""
    def run(batch):
        offsets, data = text_bytes(batch.column(1))
        for i, j in blocks(offsets):
            doc, start, count, key, context = of_block(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]])
            yield pa.RecordBatch.from_arrays([picked(batch.column(0), i + doc), pa.array(start, pa.int64()), pa.array(count.astype(np.int32)),
                                              pa.array(key), pa.array(context)], ["doc", "start", "windows", "key", "context"])
    return map_blocks(df, ANCHORS, run)


def picked(ids: pa.StructArray, at: np.ndarray) -> pa.StructArray:
    """The ids (id, row) of the rows at these places."""
    fields = ("id", "row")
    return pa.StructArray.from_arrays([pa.array(ids.field(f).to_numpy(zero_copy_only=False)[at], pa.int64()) for f in fields], list(fields))


def numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with ``id``, the order of documents: the key (null as the last), then a number that tells its rows apart.

    Under a key the number is a hash of the text (63 bits, negative), so rows that share both are one
    document, and it is the same at every reading. Rows without a key are a document each; their numbers
    (not negative) depend on the place in the files, so these rows are written once.
    """
    own = F.col(key).cast("long")
    by_text = F.xxhash64(F.col(text)).bitwiseOR(F.lit(-(1 << 63)))
    known = df.where(own.isNotNull()).withColumn("id", F.struct(own.alias("id"), by_text.alias("row")))
    unknown = df.where(own.isNull()).withColumn("id", F.struct(F.lit(LAST).alias("id"), F.monotonically_increasing_id().alias("row")))
    return known.unionByName(staged(unknown, "unnamed"))


def documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """id (see ``numbered``) and text."""
    return numbered(df.select(key, text), key, text).select("id", F.col(text).alias("text"))


def repeated(found: DataFrame) -> DataFrame:
    """Groups whose key occurs more than once. Keys are counted on the map side first.

    The repeated keys are written, so that both sides of the join are plain shuffles and hot keys are split.
    """
    often = staged(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    return found.join(often, "key", "left_semi")


def contexts(occurrences: DataFrame) -> DataFrame:
    """key, context, windows, n (occurrences), doc and start of the first one, and ``rivals``: contexts under the key."""
    each = occurrences.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("first"), F.first("windows").alias("windows"))
    each = staged(each.select("key", "context", "n", "windows", F.col("first.doc").alias("doc"), F.col("first.start").alias("start")), "contexts")
    several = staged(each.groupBy("key").agg(F.count("*").alias("rivals")).where("rivals > 1"), "several")
    return each.join(several, "key", "left").withColumn("rivals", F.coalesce("rivals", F.lit(1)))


def possibly_in(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that may be among ``ids`` (column doc), and those that certainly are not.

    A bit table of fixed size is broadcast: ``FILTER_BITS`` / 64 rows at most, whatever the input. The
    more ids, the fewer documents it spares; nothing else depends on it.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words = (ids.select(bit("doc").alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")))
    words = F.broadcast(staged(words, "filter"))
    marked = docs.withColumn("bit", bit("id")).withColumn("word", F.shiftright("bit", 6)).join(words, "word", "left")
    hit = F.coalesce(F.expr("(shiftright(mask, cast(bit & 63 as int)) & 1) = 1"), F.lit(False))
    return marked.where(hit).select(*docs.columns), marked.where(~hit).select(*docs.columns)


def covered(length: int, spans: list[tuple[int, int]], window: int) -> np.ndarray:
    """Whether each unit of a text of this length lies under a window that starts in one of the spans [from, to)."""
    edge = np.zeros(length + 1, np.int64)
    for a, b in spans:
        if a < length:
            edge[a] += 1
            edge[min(b + window - 1, length)] -= 1
    return np.cumsum(edge[:-1]) > 0


def apply_spans(rows: DataFrame, spans: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(rows)`` over all rows of a ``numbered`` frame, without their ids, each with the spans (arrays ``froms`` and ``tos``) of its document.

    Only documents that may have spans are shuffled to meet them. Rows of one document bring the same spans, which count once.
    """
    per = spans.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    per = staged(per.select("doc", F.col("spans.a").alias("froms"), F.col("spans.b").alias("tos")), "spans")
    own = [c for c in rows.columns if c != "id"]
    some, none = possibly_in(rows, per)
    met = some.join(per, some["id"] == per["doc"], "left").select(*own, "froms", "tos")
    clear = none.select(*own, F.lit(None).cast("array<bigint>").alias("froms"), F.lit(None).cast("array<bigint>").alias("tos"))
    return map_blocks(met, schema, fn).union(map_blocks(clear, schema, fn))
