"""History reports (O25, O26): last event by type, detail, chain, latest row."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import percent_of


def of_greatest(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Rows with the greatest ``order`` of their group, all of them where it ties; null only where the group has no other.

    The greatest values come from a hash aggregate of one fixed-width column that combines on the map
    side, so a hot group costs no more than the others; a semi join then keeps the rows. Wide rows are
    neither sorted nor carried through an aggregate.
    """
    top = df.groupBy(*by).agg(F.max(order).alias(order))
    same = reduce(Column.__and__, [F.col(f"r.`{c}`").eqNullSafe(F.col(f"t.`{c}`")) for c in (*by, order)])
    return df.alias("r").join(top.alias("t"), same, "left_semi")


def last_by_type_wide(history: DataFrame, keys: Sequence[str], kind: str, kinds: dict[str, str], order: str,
                      payload: Sequence[str]) -> DataFrame:
    """One row per key, with the last row of each kind side by side.

    ``kinds`` maps a stored code to a column prefix. The last row of each kind is found first
    (``of_greatest``); the rows are laid side by side from those alone.
    """
    row = F.struct(*payload)

    def last(code: str) -> Column:
        mine = F.col(kind) == code
        return F.max_by(F.when(mine, row), F.when(mine, F.col(order)))

    wide = (of_greatest(history.where(F.col(kind).isin(list(kinds))), [*keys, kind], order)
            .groupBy(*keys).agg(*[last(c).alias(f"_{p}") for c, p in kinds.items()]))
    return wide.select(*keys, *[F.col(f"_{p}.{c}").alias(f"last_{p}_{c}") for p in kinds.values() for c in payload])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; later columns break ties among the rows that are left."""
    best = of_greatest(df, keys, order[0]).groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload])


def backup_detail(files: DataFrame, set_key: Sequence[str], size: str, compressed: str,
                  bytes_per_unit: int = 1048576) -> DataFrame:
    """File rows with the size of the set split over its files, and the compression percentage.

    The file count comes from an aggregate joined back, not from a window: a set of any size then
    needs no task of its own.
    """
    counts = files.groupBy(*set_key).agg(F.count(F.lit(1)).alias("file_count"))

    def share(c: str) -> Column:
        # Sizes that fit a long divide as longs; the decimal division is for the rest.
        per = f"(file_count * {bytes_per_unit})"
        return F.expr(f"coalesce(try_cast({c} AS BIGINT) div {per}, CAST({c} AS DECIMAL(20,0)) div {per})")

    saved = F.col(size).cast("decimal(20,0)") - F.col(compressed).cast("decimal(20,0)")
    return (files.join(counts, list(set_key))
            .withColumn("size_mb", share(size))
            .withColumn("compressed_size_mb", share(compressed))
            .withColumn("compression_percent", percent_of(saved, size)))


def chain_report(files: DataFrame, group: Sequence[str], location: str) -> DataFrame:
    """The distinct locations of each group with their number.

    The distinct rows feed both the list and the count, so the history is shuffled once, reduced.
    """
    places = files.select(*group, location).distinct()
    counts = places.groupBy(*group).agg(F.count(location).alias("number_of_paths"))
    return places.join(counts, list(group))
