"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

1. Each 200-byte window is routed by an anchor, the smallest hash of a 64-byte string inside it (see
   ``repeats``). Strings whose anchor occurs once cannot repeat; equal contexts repeat as a whole.
2. The contexts left, different ones under a shared anchor, go to shards by anchor. A shard cuts them to
   the windows that may have an equal elsewhere: a window holds one of ``PIECES`` stretches around its
   anchor, so where no other context has that stretch, no window with it repeats (``shared_parts``). What
   is left makes blocks; each gets its Burrows-Wheeler transform (rotations of its strings, sorted).
3. A shard merges the transforms of its blocks by interleave refinement: one vector says from which
   block each place of the merged order comes. A round reads the blocks' symbols (four bytes at once, by
   their rank in the shard; two where there are over 65,536 different ones) in that order and deals the
   vector out again by symbol, stably; after d rounds the order is right for the first 4 d bytes, and the
   boundaries seen so far tell which neighbours share them. After 50 rounds the runs without a boundary are the repeated intervals. No suffix is sorted again.

Anchors with very many different contexts would overfill a shard; their windows are compared by two
64-bit hashes instead, as rows that Spark spreads and counts on the map side. Nothing is left out.

Null texts are empty; texts under 200 bytes lose nothing. Every row is judged by its own text, whatever
its id: rows that share an id and a text repeat each other, and what is found in one text is not taken
from another of the same id or of none. Removal may cut a character of several bytes; the
kept bytes are returned as they are.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import staged
from .repeats import DOC, anchors, apply_spans, contexts, covered, documents, groups, numbered, order_keys, picked, possibly_in, repeated
from .text import U64, Substrings, map_blocks, text_bytes

WINDOW = 200
FOOTPRINT = 64
SHARD_CONTEXTS = 500  # on average
BLOCK_CONTEXTS = 128
PIECES = 8
RANKS = 1 << 16
CROWDED = 1_000  # different contexts under one anchor beyond which windows are compared as rows


def byte_groups(offsets: np.ndarray, data: np.ndarray, window: int = WINDOW, footprint: int = FOOTPRINT):
    """Window groups of a block of documents, anchored at the smallest hash of ``footprint`` bytes."""
    n = len(data)
    text = Substrings(data)
    keys = np.full(n, 0xFFFFFFFFFFFFFFFF, U64)
    at = np.arange(max(n - footprint + 1, 0))
    hashes = np.zeros(n, U64)
    hashes[:len(at)] = text.hash(at, at + footprint)
    ordered, bits = order_keys(hashes, n)
    room = np.repeat(offsets[1:] - footprint, np.diff(offsets))
    fits = np.arange(n) <= room
    keys[fits] = ordered[fits]
    return groups(keys, bits, offsets, window, footprint, text, Substrings(data, 1))


def transform(strings: list[bytes], depth: int = WINDOW, read: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a block: the ``read`` (two or four) symbols before each sorted rotation, and where it starts.

    Each string ends with symbol 255, which no text holds, and turns around on its own. Rotations alike
    for ``depth`` symbols and more may stand in any order.
    """
    lengths = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(lengths)
    text = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8).astype(np.int64)
    base = np.repeat(ends - lengths, lengths)
    size = np.repeat(lengths, lengths)
    place = np.arange(len(text)) - base
    key = np.zeros(len(text), U64)
    for k in range(8):
        key = key << U64(8) | text[base + (place + k) % size].astype(U64)
    step = 8
    while True:
        order = np.argsort(key)
        new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(len(text), np.int64)
        rank[order] = new
        if step >= depth or new[-1] == len(text) - 1:
            break
        key = rank * len(text) + rank[base + (place + step) % size]
        step *= 2
    before = np.zeros(len(text), np.int64)
    for k in range(read, 0, -1):
        before = before << 8 | text[base + (place - k) % size]
    return before[order].astype(np.uint16 if read == 2 else np.uint32), order


def merge(transforms: list[np.ndarray], strings: list[np.ndarray], valid: list[np.ndarray], depth: int = WINDOW, read: int = 2) -> np.ndarray:
    """Whether each row of the blocks, one block after the other, is alike with another valid row for ``depth`` symbols.

    ``strings`` numbers the string of each row, ``valid`` marks the rotations that start a window. ``read``
    symbols, which ``depth`` is a multiple of, settle per round. Strings without a valid row that is alike with another so far can take no
    part any more and leave together with all their rotations.
    """
    symbols, owner, starts = (np.concatenate(x) for x in (transforms, strings, valid))
    if read > 2:
        ranks, number = np.unique(symbols, return_inverse=True)
        # 16 bits are sorted in linear time; the last two symbols stand in the low ones.
        symbols, read = (number.astype(np.uint16), read) if len(ranks) <= RANKS else (symbols.astype(np.uint16), 2)
    source = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    row = np.arange(len(symbols))
    alike = np.zeros(len(symbols), bool)
    interval = np.zeros(len(symbols), np.int32)
    for done in range(read, depth + 1, read):
        # Each block's symbols are read in their own order, in the order of the merge so far.
        own = np.argsort(source, kind="stable")
        seen = np.empty_like(symbols)
        seen[own] = symbols
        deal = np.argsort(seen, kind="stable")
        dealt, was = seen[deal], interval[deal]
        source = source[deal]
        interval = np.zeros(len(deal), np.int32)
        np.cumsum((dealt[1:] != dealt[:-1]) | (was[1:] != was[:-1]), out=interval[1:])
        if done < depth and done % 16:
            continue
        own = np.argsort(source, kind="stable")
        of = interval[own]
        again = (np.bincount(of[starts], minlength=int(interval[-1]) + 1) > 1)[of] & starts
        if done == depth:
            alike[row[again]] = True
            break
        stays = np.zeros(int(owner.max()) + 1, bool)
        stays[owner[again]] = True
        keep = stays[owner]
        if not keep.any():
            break
        merged = np.empty(len(own), bool)
        merged[own] = keep
        symbols, owner, starts, row = symbols[keep], owner[keep], starts[keep], row[keep]
        source, interval = source[merged], interval[merged]
    return alike


def repeated_starts(shard: list[list[bytes]], window: int = WINDOW) -> list[list[np.ndarray]]:
    """For each string of each block, the starts of the windows that occur elsewhere in the shard; ``window`` is even."""
    transforms, strings, valid, orders, count = [], [], [], [], 0
    read = 2 if window % 4 else 4
    for block in shard:
        symbols, order = transform(block, window, read)
        lengths = np.array([len(s) + 1 for s in block])
        number = np.repeat(np.arange(len(block)), lengths)
        last = np.repeat(np.cumsum(lengths) - 1 - window, lengths)  # the last start of a window in each string
        transforms.append(symbols)
        strings.append(number[order] + count)
        valid.append((np.arange(len(number)) <= last)[order])
        orders.append(order)
        count += len(block)
    alike = merge(transforms, strings, valid, window, read)
    out, at = [], 0
    for block, order in zip(shard, orders):
        again = np.zeros(len(order), bool)
        again[order] = alike[at:at + len(order)]
        at += len(order)
        ends = np.cumsum([len(s) + 1 for s in block])
        out.append([np.flatnonzero(again[e - len(s) - 1:e]) for s, e in zip(block, ends)])
    return out


def shared_parts(bodies: list[bytes], keys: np.ndarray, window: int = WINDOW, footprint: int = FOOTPRINT, pieces: int = PIECES) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows of each context that may occur in another context; last < first where none may.

    Equal windows have their anchor at the same place. With ``x`` to ``y`` bytes before it, a window holds the stretch from
    ``x`` bytes before the anchor to ``window - footprint - y`` behind it. ``keys``: hashes of the anchors.
    """
    spare = window - footprint
    sizes = np.array([len(b) for b in bodies], np.int64)
    base = np.append(0, np.cumsum(sizes))
    text = Substrings(np.frombuffer(b"".join(bodies), np.uint8))
    last, base = sizes - window, base[:-1]
    # The anchor is the first place of its hash that all windows of the context hold.
    room = spare - last + 1
    owner = np.repeat(np.arange(len(bodies)), room)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room) + last[owner]
    at = base[owner] + place
    hits = np.flatnonzero(text.hash(at, at + footprint).view(np.int64) == keys[owner])
    found, first = np.unique(owner[hits], return_index=True)
    anchor = np.full(len(bodies), -1)
    anchor[found] = place[hits[first]]
    low, high = np.where(anchor < 0, 0, window), np.where(anchor < 0, last, -1)
    edges = np.arange(pieces + 1) * (spare + 1) // pieces
    for x, y in zip(edges[:-1], edges[1:] - 1):
        a, b = np.maximum(anchor - y, 0), np.minimum(anchor - x, last)
        own = np.flatnonzero((anchor >= 0) & (a <= b))
        start = base[own] + anchor[own]
        _, which, count = np.unique(text.hash(start - x, start + window - y), return_inverse=True, return_counts=True)
        own = own[count[which] > 1]
        low[own], high[own] = np.minimum(low[own], a[own]), np.maximum(high[own], b[own])
    return low, high


def _rows(some: DataFrame, per: DataFrame) -> DataFrame:
    return some.join(per, some["id"] == per["doc"]).select("id", "text", "starts", "counts", "keys")


def _context_strings(rows: DataFrame, window: int) -> DataFrame:
    """doc, start, key, body: bytes of the contexts."""
    def run(batch):
        for r in range(batch.num_rows):
            raw = (batch.column(1)[r].as_py() or "").encode()
            starts, counts, keys = (batch.column(c)[r].as_py() for c in (2, 3, 4))
            bodies = [raw[s:s + c - 1 + window] for s, c in zip(starts, counts)]
            yield pa.RecordBatch.from_arrays([picked(batch.column(0), np.full(len(starts), r)), pa.array(starts, pa.int64()),
                                              pa.array(keys, pa.int64()), pa.array(bodies, pa.binary())], ["doc", "start", "key", "body"])
    return map_blocks(rows, f"{DOC}, start long, key long, body binary", run)


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """doc, start, one, two: the windows of the contexts by their hashes."""
    def run(batch):
        offsets, data = text_bytes(batch.column(1))
        starts, counts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for r in range(batch.num_rows):
            own = data[offsets[r]:offsets[r + 1]]
            at = np.concatenate([np.arange(a, a + c) for a, c in zip(starts[r], counts[r])])
            at = at[at + window <= len(own)]
            yield pa.RecordBatch.from_arrays([picked(batch.column(0), np.full(len(at), r)), pa.array(at), *(pa.array(Substrings(own, k).hash(at, at + window).view(np.int64)) for k in (0, 1))],
                                             ["doc", "start", "one", "two"])
    return map_blocks(rows, f"{DOC}, start long, one long, two long", run)


def _merged(strings: DataFrame, window: int, footprint: int) -> DataFrame:
    """doc, a, b: repeated windows of the contexts, shard by shard; rows (shard, doc, start, key, body)."""
    ids = pa.struct([("id", pa.int64()), ("row", pa.int64())])

    def settle(held: list[pa.RecordBatch]):
        docs, starts, keys, bodies = (pa.chunked_array([h.column(c) for h in held]) for c in (1, 2, 3, 4))
        bodies = bodies.to_pylist()
        low, high = shared_parts(bodies, keys.to_numpy(), window, footprint)
        left = np.flatnonzero(low <= high)
        parts = [bodies[i][low[i]:high[i] + window] for i in left]
        blocks = [parts[k:k + BLOCK_CONTEXTS] for k in range(0, len(parts), BLOCK_CONTEXTS)]
        found = [at for block in repeated_starts(blocks, window) for at in block] if blocks else []
        names, starts = docs.take(pa.array(left)).to_pylist(), starts.to_numpy()[left] + low[left]
        doc, a, b = [], [], []
        for d, s, at in zip(names, starts, found):
            if len(at):
                opens = np.flatnonzero(np.append(True, np.diff(at) > 1))
                last = np.append(opens[1:], len(at)) - 1
                doc += [d] * len(opens)
                a += (s + at[opens]).tolist()
                b += (s + at[last] + 1).tolist()
        return pa.RecordBatch.from_arrays([pa.array(doc, ids), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc", "a", "b"])

    def run(batches):
        shard, held = None, []
        for batch in batches:
            names = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
            for i, j in zip(edges, np.append(edges[1:], len(names))):
                if names[i] != shard:
                    if held:
                        yield settle(held)
                    shard, held = names[i], []
                held.append(batch.slice(i, j - i))
        if held:
            yield settle(held)

    return strings.mapInArrow(run, f"{DOC}, a long, b long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, footprint: int = FOOTPRINT, crowded: int = CROWDED) -> DataFrame:
    """doc, a, b: windows that start in [a, b) occur elsewhere too. ``docs``: id, text."""
    found = anchors(docs, lambda offsets, data: byte_groups(offsets, data, window, footprint))
    occurrences = staged(repeated(found), "occurrences")
    each = staged(contexts(occurrences), "rivals")
    often = each.where("n > 1").select("key", "context")
    whole = occurrences.join(often, ["key", "context"], "left_semi").select("doc", F.col("start").alias("a"), (F.col("start") + F.col("windows")).alias("b"))

    def chosen(which):
        per = each.where(which).groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("counts"), F.collect_list("key").alias("keys"))
        per = staged(per, "unsure")
        return _rows(possibly_in(docs, per)[0], per)

    # One representative of each context stands for all its occurrences, which ``whole`` has settled.
    shards = each.where(f"rivals between 2 and {crowded}").count() // SHARD_CONTEXTS + 1
    strings = _context_strings(chosen(f"rivals between 2 and {crowded}"), window)
    dealt = strings.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "doc", "start", "key", "body").repartition("shard").sortWithinPartitions("shard", "doc", "start")
    some = _merged(dealt, window, footprint)
    rows = staged(_windows(chosen(f"rivals > {crowded}"), window), "windows")
    often = rows.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1")
    single = rows.join(often, ["one", "two"], "left_semi").select("doc", F.col("start").alias("a"), (F.col("start") + 1).alias("b"))
    return whole.union(some).union(single)


def _kept(text: str | None, froms, tos, window: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return raw, covered(len(raw), list(zip(froms, tos)) if froms is not None else [], window)


def removal_digests(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = numbered(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    spans = repeated_spans(rows.select("id", "text"), window)

    def run(batch):
        out = []
        for t, a, b in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
            raw, gone = _kept(t, a, b, window)
            opens = int((gone & ~np.append(False, gone[:-1])).sum())
            out.append((len(raw), int(gone.sum()), opens, hashlib.sha256((raw[~gone] if opens else raw).tobytes()).hexdigest()))
        n, removed, opens, digest = zip(*out)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(opens, pa.int64()), pa.array(digest)],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return apply_spans(rows, spans, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
