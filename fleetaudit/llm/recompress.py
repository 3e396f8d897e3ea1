"""Removal of long repeated passages, found by recompression.

Words are level 0. A round names runs of one symbol, then pairs of neighbours whose names draw a left
and a right; what neither run nor pair takes stays. Names are hashes of what they stand for, so they
are the same in every task and for the whole corpus without exchanging a table, and equal passages get
equal symbols inside. Which words a symbol's shape depends on is tracked as it is built: a symbol whose
dependence lies within ``FOOTPRINT`` words is the same in every copy of these words, whatever stands
around them.

Each window of 20 words picks such a symbol, of the highest level it holds, as its anchor. Spark counts
the anchors' keys; shared ones reveal possible repeats, equal contexts confirm whole groups, and where
contexts differ the windows themselves are compared (by two 64-bit hashes). Windows inside a run so long
that they hold no symbol of their own, like one word forty times, are compared directly. The first
occurrence, by document and start, stays.

Null texts have no words. Texts shorter than a window lose nothing. Rows that share an id and a text
are one document and lose the same words; different texts under one id are different documents, in the
order of a hash of the text. Rows with a null id come after all others, each a document of its own, in
the order in which they are read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import staged
from .repeats import DOC, anchors, apply_spans, contexts, covered, groups, numbered, picked, possibly_in, repeated
from .text import U64, Substrings, Words, blocks, map_blocks, mix, text_bytes

WINDOW = 20
FOOTPRINT = 8
ROUNDS = 2
FAR = 1 << 40


class Symbols:
    """Symbols of one level: name, document, first word, and the words their shape depends on."""

    def __init__(self, name, doc, low, high):
        self.name, self.doc, self.low, self.high = name, doc, low, high

    def _neighbours(self):
        """Dependence of the symbol before and after each one; beyond a document's edge it is unbounded."""
        same = self.doc[1:] == self.doc[:-1]
        low_before = np.append(-FAR, np.where(same, self.low[:-1], -FAR))
        high_before = np.append(-FAR, np.where(same, self.high[:-1], -FAR))
        low_after = np.append(np.where(same, self.low[1:], FAR), FAR)
        high_after = np.append(np.where(same, self.high[1:], FAR), FAR)
        return low_before, high_before, low_after, high_after

    def runs(self) -> Symbols:
        """Runs of one symbol named by it and their length; a run depends on the symbols that end it."""
        opens = np.flatnonzero(np.append(True, (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])))
        last = np.append(opens[1:], len(self.name)) - 1
        count = (last - opens + 1).astype(U64)
        name = self.name[opens]
        name = np.where(count > 1, mix(name * U64(0xA24BAED4963EE407) + count), name)
        low_before, _, _, high_after = self._neighbours()
        return Symbols(name, self.doc[opens], np.minimum(low_before[opens], self.low[opens]), np.maximum(high_after[last], self.high[last]))

    def pairs(self, turn: int) -> Symbols:
        """Left and right neighbours joined; a symbol left alone depends on the neighbour that did not match."""
        right = (mix(self.name + U64(turn * 0x632BE59BD9B4E019 % (1 << 64))) >> U64(63)).astype(bool)
        joins = np.append(~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1]), False)
        second = np.append(False, joins[:-1])
        low_before, high_before, low_after, high_after = self._neighbours()
        low = np.where(right, np.minimum(self.low, low_before), np.minimum(self.low, low_after))
        high = np.where(right, np.maximum(self.high, high_before), np.maximum(self.high, high_after))
        name = self.name.copy()
        at = np.flatnonzero(joins)
        name[at] = mix(self.name[at] * U64(0x9FB21C651E98DF25) + (self.name[at + 1] ^ U64(0xD6E8FEB86659FD93)))
        keep = ~second
        return Symbols(name[keep], self.doc[keep], low[keep], high[keep])


def levels(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """Symbols after each round of recompression."""
    place = np.arange(len(names))
    now, out = Symbols(names, doc, place, place + 1), []
    for turn in range(1, rounds + 1):
        now = now.runs().pairs(turn)
        out.append(now)
    return out


def word_groups(offsets: np.ndarray, data: np.ndarray, window: int = WINDOW, footprint: int = FOOTPRINT, rounds: int = ROUNDS):
    """Window groups of a block of documents, anchored at symbols of recompression."""
    words = Words(offsets, data)
    names, n = mix(words.hashes), len(words.starts)
    keys = np.full(n, 0xFFFFFFFFFFFFFFFF, U64)
    bits = max(20, int(n).bit_length())
    top = words.first[1:]
    for level, s in enumerate(levels(names, words.doc, rounds) if n else [], 1):
        fits = np.flatnonzero((s.high - s.low <= footprint) & (s.low >= 0))
        low = s.low[fits]
        fits = fits[(low >= words.first[s.doc[fits]]) & (low + footprint <= top[s.doc[fits]])]
        low = s.low[fits]
        # Higher levels come first, then smaller names, then the leftmost.
        value = (U64(rounds - level) << U64(62)) | (mix(s.name[fits]) >> U64(2 + bits) << U64(bits)) | low.astype(U64)
        np.minimum.at(keys, low, value)
    return groups(keys, bits, words.first, window, footprint, Substrings(names), Substrings(names, 1))


def _windows(df: DataFrame, window: int) -> DataFrame:
    """doc, start, one, two: hashes of the windows of some groups; rows (id, text, starts, counts)."""
    def run(batch):
        offsets, data = text_bytes(batch.column(1))
        starts, counts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i, j in blocks(offsets):
            words = Words(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]])
            names = mix(words.hashes)
            one, two = Substrings(names), Substrings(names, 1)
            at = [np.concatenate([np.arange(a, a + c) for a, c in zip(starts[r], counts[r])]) for r in range(i, j)]
            number = np.diff(words.first)
            at = [a[a + window <= k] for a, k in zip(at, number)]
            owner = np.repeat(np.arange(j - i), [len(a) for a in at])
            start = np.concatenate(at)
            place = start + words.first[owner]
            yield pa.RecordBatch.from_arrays([picked(batch.column(0), i + owner), pa.array(start), pa.array(one.hash(place, place + window).view(np.int64)),
                                              pa.array(two.hash(place, place + window).view(np.int64))], ["doc", "start", "one", "two"])
    return map_blocks(df, f"{DOC}, start long, one long, two long", run)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, a, b: windows that start in [a, b) also start earlier in the corpus. ``docs``: id, text."""
    found = anchors(docs, lambda offsets, data: word_groups(offsets, data, window))
    occurrences = staged(repeated(found), "occurrences")
    each = staged(contexts(occurrences), "rivals")
    # All but the first occurrence of a context repeat as a whole.
    first = each.where("n > 1").select("key", "context", F.col("doc").alias("doc0"), F.col("start").alias("start0"))
    later = (occurrences.join(first, ["key", "context"]).where("doc <> doc0 or start <> start0")
             .select("doc", F.col("start").alias("a"), (F.col("start") + F.col("windows")).alias("b")))
    # First occurrences of contexts that share a key: window by window.
    unsure = each.where("rivals > 1").groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("counts"))
    unsure = staged(unsure, "unsure")
    some, _ = possibly_in(docs, unsure)
    rows = some.join(unsure, some["id"] == unsure["doc"]).select("id", "text", "starts", "counts")
    windows = staged(_windows(rows, window), "windows")
    earliest = windows.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("first")).where("n > 1")
    single = (windows.join(earliest, ["one", "two"]).where("doc <> first.doc or start <> first.start")
              .select("doc", F.col("start").alias("a"), (F.col("start") + 1).alias("b")))
    return later.union(single)


def _kept(text: str | None, froms, tos, window: int) -> tuple[list[bytes], np.ndarray]:
    words = (text or "").encode().split()
    spans = list(zip(froms, tos)) if froms is not None else []
    return words, covered(len(words), spans, window)


def removal_digests(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: the kept words, joined by one space."""
    rows = numbered(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    spans = repeated_spans(rows.select("id", "text"), window)

    def run(batch):
        out = []
        for t, a, b in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
            words, gone = _kept(t, a, b, window)
            kept = [w for w, g in zip(words, gone) if not g] if gone.any() else words
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, removed, digest = zip(*out)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)],
                                         ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return apply_spans(rows, spans, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with repeated passages cut out of its texts; texts without any stay as they are, white space too.

    Where words are cut, the kept ones are joined by one space. A text that loses all its words becomes empty.
    """
    # The caller's other columns travel in one, out of the way of all others.
    others = [c for c in df.columns if c != text]
    packed = df.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("others"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = numbered(packed, "key", "text")
    spans = repeated_spans(rows.select("id", "text"), window)
    names, place = df.columns, df.columns.index(text)

    def run(batch):
        out = []
        for t, a, b in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
            if a is not None:
                words, gone = _kept(t, a, b, window)
                if gone.any():
                    t = b" ".join(w for w, g in zip(words, gone) if not g).decode()
            out.append(t)
        columns = batch.column(0).flatten()[1:]
        columns.insert(place, pa.array(out, pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names)

    return apply_spans(rows, spans, run, df.schema)
