"""Mixing sources to target weights along a time-varying curriculum; built-in functions only.

Targets: the sources, ordered by code point with null last, weigh 3, 1, 2, repeating, and share a
given part of all words. A source's target stops at twice its words; the excess goes to the others by
weight until none is above. That is one level: targets are ``least(cap, level * weight)``, and the
level follows from running sums over the sources in the order of cap per weight.

Curriculum: a source's weight changes linearly over the training from ``a`` to ``2 - a`` times its
mean. Its demand up to time t is the integral ``a t + (1 - a) t^2`` of its target; inverting it gives
the time at which each of its words is due. A source's documents follow each other in a random but
fixed order (hash of the key), twice if its target exceeds its words. The document at the target is
taken in part, so targets are met to the word.

Nothing holds a whole source: running sums go over 4,096 slices of the hash, then within a slice. Nor
does anything hold all sources: they are dealt by ranges of their order, summed in a range, then over
the ranges, of which there are ``PARTS`` at most. Texts take no part in the planning: the plan is made
on a row's number, size and source, and meets the texts once, before they are sorted by position.

Null texts have no words and are taken with zero. Repeated rows are separate documents. Rows without
a key are ordered by a hash of their text. Empty tables give empty results.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stage import staged

# Words are maximal runs of other characters than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
STARTS = (1.5, 1.0, 0.5)  # ``a`` of the sources, repeating in the same order
SHARE = 1.5
CAP = 2
SLICE_DIGITS = 3  # of the hash, in hexadecimal
PARTS = 64  # ranges of sources


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents with ``size`` in words and their ``place`` and ``slice`` in the source's order."""
    place = F.md5(F.coalesce(F.col(key).cast("string"), F.hex(F.xxhash64(text))).cast("binary"))
    return (docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
            .withColumn("place", place).withColumn("slice", F.substring("place", 1, SLICE_DIGITS)))


def targets(sizes: DataFrame, source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP, starts=STARTS) -> DataFrame:
    """One row per source: ``of``, ``source_size``, ``target``, ``opening`` (the curriculum's ``a``)."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("number") % len(values) + 1).cast("int"))
    per = sizes.groupBy(F.col(source).alias("of")).agg(F.sum("size").alias("source_size"))
    per = _running(per, [F.col("of").asc_nulls_last()], number=F.lit(1))
    per = per.withColumn("weight", pick(weights)).withColumn("opening", pick(starts)).withColumn("cap", cap * F.col("source_size"))
    per = per.select("of", "source_size", "number", "weight", "opening", "cap")
    per = _running(per, [(F.col("cap") / F.col("weight")).asc(), F.col("number").asc()], caps=F.col("cap"), weights=F.col("weight"), sizes=F.col("source_size"))
    per = per.withColumn("level", (share * F.col("all_sizes") - F.col("caps")) / (F.col("all_weights") - F.col("weights")))
    # Sources below their cap at the level they find share what is left; the first of them, where the level is highest, sets it.
    found = per.groupBy("every").agg(F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).alias("set_level"))
    per = per.join(found, "every")
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("set_level") * F.col("weight"), F.col("cap").cast("double")))
    return per.select("of", "source_size", target.alias("target"), "opening")


def _running(rows: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """``rows`` with the sum of each value over the rows before, its sum over all (``all_``), and ``every``, which is 0.

    Rows are dealt to ranges of the order and written, so that all readings see the same ranges; sums go
    within a range, and over the ranges' totals.
    """
    rows = rows.select("*", *[v.cast("long").alias(f"of_{n}") for n, v in values.items()])
    rows = staged(rows.repartitionByRange(PARTS, *order).withColumn("part", F.spark_partition_id()), "ranges")
    ranges = rows.groupBy("part").agg(*[F.sum(f"of_{n}").alias(n) for n in values]).withColumn("every", F.pmod("part", F.lit(1)))
    over, earlier = Window.partitionBy("every"), Window.partitionBy("every").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", "every", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"prior_{n}") for n in values], *[F.sum(n).over(over).alias(f"all_{n}") for n in values])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ranges, "part")
    return rows.withColumns({n: F.col(f"prior_{n}") + F.coalesce(F.sum(f"of_{n}").over(within), F.lit(0)) for n in values})


def _due(words: Column) -> Column:
    """Time from 0 to 1 at which the source's demand reaches so many words."""
    x, a = F.least(words / F.col("whole"), F.lit(1.0)), F.col("opening")
    bend = F.lit(1.0) - a
    return F.when(bend == 0, x).otherwise((F.sqrt(a * a + 4 * bend * x) - a) / (2 * bend))


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, starts=STARTS) -> DataFrame:
    """``rows`` (row, key, source, size, place, slice, tie) with source_size, target, taken_first, taken_second, taken, position, second_position.

    ``taken_first`` and ``taken_second`` are the words taken in the source's first and second round,
    positions are the times (in billionths) of the first word taken, null where none is.
    """
    slices = rows.groupBy(F.col("source").alias("of"), F.col("slice").alias("in_slice")).agg(F.sum("size").alias("size"))
    goal = targets(slices, "of", weights, share, cap, starts).withColumnRenamed("of", "owner")
    before = F.sum("size").over(Window.partitionBy("of").orderBy("in_slice")) - F.col("size")
    goal = slices.withColumn("offset", before).drop("size").join(goal, F.col("of").eqNullSafe(F.col("owner"))).drop("owner")
    within = Window.partitionBy("source", "slice").orderBy("place", "key", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum("size").over(within) - F.col("size"))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("in_slice")))
    rows = rows.withColumn("start", F.col("start") + F.col("offset")).withColumn("whole", F.round("target").cast("long"))
    clip = lambda e: F.least(F.greatest(e, F.lit(0)), F.col("size")).cast("long")
    due = lambda words: F.floor(_due(words) * 1e9).cast("long")
    rows = rows.withColumn("taken_first", clip(F.col("whole") - F.col("start")))
    rows = rows.withColumn("taken_second", clip(F.col("whole") - F.col("source_size") - F.col("start")))
    rows = rows.withColumn("taken", F.col("taken_first") + F.col("taken_second"))
    rows = rows.withColumn("position", F.when(F.col("taken_first") > 0, due(F.col("start"))))
    rows = rows.withColumn("second_position", F.when(F.col("taken_second") > 0, due(F.col("source_size") + F.col("start"))))
    return rows.select("row", "key", "source", "size", "source_size", "target", "taken_first", "taken_second", "taken", "position", "second_position")


def _narrow(docs: DataFrame, row: Column, key: str, text: str, source: str) -> DataFrame:
    """What the plan is made on: no texts."""
    rows = docs.select(row.alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    return sized(rows, "key", "text", "source").withColumn("tie", F.xxhash64("text")).drop("text")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The plan of every row of ``docs``: its key and source, and the columns of ``plan``."""
    rows = plan(_narrow(docs, F.lit(None).cast("long"), key, text, source), **how)
    return rows.drop("row").withColumnsRenamed({"key": key, "source": source})


def training_order(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed corpus: a row of the columns of ``docs`` for each time a document is taken, range-sorted by position.

    A document taken in part keeps its first words as they stand. Rows are known by their place in their files, or, where
    ``docs`` does not come straight from files, by a number they are written with.
    """
    names = docs.columns
    own = F.struct(*[F.col(f"`{c}`") for c in names]).alias("own")
    try:
        rows = docs.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("row"), own)
    except AnalysisException:
        rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), own), "numbered")
    narrow = rows.select("row", F.col("own")[key].alias("key"), F.col("own")[source].alias("source"), F.col("own")[text].alias("text"))
    planned = plan(_narrow(narrow, F.col("row"), "key", "text", "source"), **how)
    rounds = F.array(F.struct(F.col("taken_first").alias("words"), F.col("position").alias("at"), F.lit(1).alias("round")),
                     F.struct(F.col("taken_second").alias("words"), F.col("second_position").alias("at"), F.lit(2).alias("round")))
    turns = planned.select("row", "key", "size", F.filter(rounds, lambda r: r["words"] > 0).alias("turns")).where(F.size("turns") > 0)
    # One row with its turns meets its text; the turns part afterwards.
    taken = rows.join(turns, "row").withColumn("turn", F.explode("turns"))
    head = F.expr(f"array_join(slice(regexp_extract_all(own.`{text}`, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, cast(turn.words as int)), '')")
    cut = F.when(F.col("turn.words") >= F.col("size"), F.col("own")[text]).otherwise(head)
    return taken.orderBy("turn.at", "turn.round", "key").select(*[cut.alias(c) if c == text else F.col("own")[c].alias(c) for c in names])
