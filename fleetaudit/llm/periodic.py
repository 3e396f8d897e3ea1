"""Periodic runs of words: seeds on diagonals, extended once each.

A run is a longest stretch of words with smallest period q and at least max(``min_length``,
``min_exponent`` * q) words: words q apart are equal in it, and no neighbouring word goes on with the period.
On the diagonal of lag q a run is a stretch of equal words of at least that length less q, so any k
words of that guaranteed overlap are a seed. Periods are taken in classes, each with the k that its smallest
period guarantees and up to period k: k words then recur inside a run at multiples of q only, so
the pairs of neighbouring occurrences in a document hold every seed, and no pair of a group but these is formed.

k-grams are indexed by exact names: words are numbered by their bytes, names of pairs double the length.
Seeds are taken by lag and place; a table of the furthest word covered on each lag passes over the seeds that a
stretch already holds, the others are extended to both sides by comparing words. Only documents
with enough recurring k-grams go to the next class of periods, so work is about n log n words.

Texts are handled whole; matches never cross documents. Null and empty texts have no words and no
runs, very long texts take the same way, equal texts give equal runs, repeated rows stay rows of their own, null keys stay null,
empty tables give empty results. Extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, blocks, map_blocks, numbered_words, text_bytes


class Grams:
    """Exact names of the k-grams of numbered words; names of pairs double the length."""

    def __init__(self, symbols: np.ndarray, room: np.ndarray):
        """``room``: words from each place to the end of its document."""
        self.room, self.names = room, [symbols]

    def _pairs(self, names: np.ndarray, step: int, at: np.ndarray) -> np.ndarray:
        return names[at] * (int(names.max(initial=0)) + 1) + names[at + step]

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places with k words left, and a key of each one's k-gram."""
        level = k.bit_length() - 1
        while len(self.names) <= level:
            size = 1 << len(self.names)
            at = np.flatnonzero(self.room >= size)
            named = np.zeros(len(self.room), np.int64)
            named[at] = np.unique(self._pairs(self.names[-1], size // 2, at), return_inverse=True)[1]
            self.names.append(named)
        at = np.flatnonzero(self.room >= k)
        names = self.names[level]
        return at, self._pairs(names, k - (1 << level), at) if k > 1 << level else names[at]

    def keep(self, mask: np.ndarray) -> None:
        self.room, self.names = self.room[mask], [n[mask] for n in self.names]


def _extend(symbols: np.ndarray, at: np.ndarray, lag: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How far each place goes on (step 1) or back (step -1) with words equal to those ``lag`` on, ``limit`` words at most."""
    reach, width = np.zeros(len(at), np.int64), 8
    live = np.flatnonzero(limit > 0)
    while len(live):
        ahead = reach[live][:, None] + np.arange(width)
        within = ahead < limit[live][:, None]
        place = at[live][:, None] + step * np.where(within, ahead, 0)
        same = within & (symbols[place] == symbols[place + lag[live][:, None]])
        run = np.where(same.all(1), width, same.argmin(1))
        reach[live] += run
        live = live[run == width]
        width = min(2 * width, max(8, (1 << 20) // max(len(live), 1)))
    return reach


def overlap(low: int, min_length: int, min_exponent: int) -> int:
    """Fewest words that a run of period ``low`` or more has in common with itself, moved by its period."""
    turn = min_length // min_exponent  # the overlap falls with the period up to here, then grows
    return min(max(min_length, min_exponent * q) - q for q in (low, max(low, turn), max(low, turn + 1)))


def runs(symbols: np.ndarray, first: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period.

    ``first[d]`` to ``first[d + 1]`` are the places of document d.
    """
    if min_exponent < 3 or min_length < 2:
        raise ValueError("runs need an exponent of at least 3 and a length of at least 2")
    n, docs = len(symbols), np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][docs]
    opening = first[:-1][docs]
    grams = Grams(symbols, end - np.arange(n))
    origin = np.arange(n)  # place in ``symbols`` of each place still looked at
    found, low = [], 1
    while len(origin):
        k = high = overlap(low, min_length, min_exponent)
        at, keys = grams.keys(k)
        if not len(at):
            break
        order = np.argsort(keys, kind="stable")
        at, keys = origin[at[order]], keys[order]
        twin = (keys[1:] == keys[:-1]) & (docs[at[1:]] == docs[at[:-1]])
        lag = at[1:] - at[:-1]
        seed = twin & (lag >= low) & (lag <= high)
        place, lag = at[:-1][seed], lag[seed]
        by = np.lexsort((place, lag))
        place, lag = place[by], lag[by]
        # The furthest word covered on this lag: a seed that begins in the words matched before adds its own to them.
        opens = np.append(True, (lag[1:] != lag[:-1]) | (place[1:] > place[:-1] + k)) if len(place) else np.zeros(0, bool)
        number = np.flatnonzero(opens)
        begin, lag_of = place[number], lag[number]
        covered = place[np.append(number[1:], len(place)) - 1] + k if len(number) else begin
        back = _extend(symbols, begin - 1, lag_of, begin - opening[begin] if len(begin) else begin, -1)
        on = _extend(symbols, covered, lag_of, end[begin] - lag_of - covered if len(begin) else begin, 1)
        start, stop = begin - back, covered + on + lag_of
        long = stop - start >= np.maximum(min_length, min_exponent * lag_of)
        found.append(np.stack([docs[start], start - opening[start], stop - start, lag_of], 1)[long])
        low = high + 1
        # A run of a later class needs so many recurring k-grams side by side.
        more = overlap(low, min_length, min_exponent) - k + 1
        again = np.zeros(n + 1, np.int64)
        again[at[:-1][twin] + 1] = 1
        again[at[1:][twin] + 1] = 1
        total = np.cumsum(again)
        full = np.flatnonzero(total[more:] - total[:-more] == more) if n >= more else np.zeros(0, np.int64)
        wanted = np.zeros(len(first) - 1, bool)
        wanted[docs[full]] = True
        mask = wanted[docs[origin]]
        origin = origin[mask]
        grams.keep(mask)
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    # Twice found only if two stretches of one lag met; one row each.
    return np.unique(rows[:, [0, 1, 3, 2]], axis=0)[:, [0, 1, 3, 2]] if len(rows) else rows


def _collapsed(words: Words, data: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of each document's kept words, joined by one space."""
    kept = np.flatnonzero(keep)
    doc = words.doc[kept]
    joined = np.append(doc[1:] == doc[:-1], False) if len(kept) else np.zeros(0, bool)  # a space follows
    starts, ends = words.starts[kept], words.ends[kept] + joined
    out = data.copy()
    out[words.ends[kept[joined]]] = 0x20
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts] += 1
    marks[ends] -= 1
    sizes = np.bincount(doc, (ends - starts).astype(np.float64), len(words.first) - 1).astype(np.int64)
    return np.append(0, np.cumsum(sizes)), out[np.cumsum(marks[:-1], dtype=np.int8) > 0]


def periodic_runs(df: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` are structs of start, length and period (words from 0), by start, then period. ``collapsed`` are the words that no
    run holds after its first period, joined by one space. One scan, no shuffle; a task holds a block of documents.
    """
    def run(batch):
        offsets, data = text_bytes(batch.column(1))
        for i, j in blocks(offsets):
            part = data[offsets[i]:offsets[j]]
            words = Words(offsets[i:j + 1] - offsets[i], part, hashed=False)
            rows = runs(numbered_words(part, words.starts, words.ends)[0], words.first, min_length, min_exponent)
            doc, start, length, period = rows.T
            gone = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(gone, words.first[doc] + start + period, 1)
            np.add.at(gone, words.first[doc] + start + length, -1)
            at, kept = _collapsed(words, part, np.cumsum(gone[:-1]) == 0)
            listed = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[i:j], pa.array(np.diff(words.first), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32()), listed),
                pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(at), pa.py_buffer(kept)).cast(pa.string())],
                ["key", "n_words", "runs", "collapsed"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_blocks(df.select(key, text), schema, run).withColumnRenamed("key", key)


def longest(runs: str | Column) -> Column:
    """The run of greatest length, then smallest start, then period; null without runs."""
    turned = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    best = F.array_max(turned)
    return F.when(F.size(runs) > 0, F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))


def listing(runs: str | Column) -> Column:
    """Every run as a line ``start,length,period``."""
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
