"""Coverage and freshness (O4-O7, O13, O19): what has no event, an old one, or a missing item."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import as_ts, minutes_between


def missing_coverage(entities: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entities with no event at all.

    The distinct keys of ``events`` are taken first: duplicates meet on the map side, and the join
    reuses that shuffle, so a key with most of the events travels as one row per task.
    """
    return entities.join(events.select(*keys).distinct(), list(keys), "left_anti")


def _last(events: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.max(ts).alias("last_event"))


def stale_last_event(entities: DataFrame, events: DataFrame, keys: Sequence[str], ts: str,
                     max_age: str, as_of) -> DataFrame:
    """Entities whose last event is at or before ``as_of - max_age``.

    The maximum is taken before the join, so the shuffle carries one row per key and map task.
    """
    limit = as_ts(as_of) - F.expr(f"INTERVAL {max_age}")
    return entities.join(_last(events, keys, ts).where(F.col("last_event") <= limit), list(keys))


def objective_breach(entities: DataFrame, events: DataFrame, keys: Sequence[str], ts: str,
                     minutes: int | str, as_of) -> DataFrame:
    """Entities past their objective, or without any event (``minutes_since`` null).

    ``minutes`` is one objective for all or the name of a column of ``entities``.
    """
    objective = F.col(minutes) if isinstance(minutes, str) else F.lit(minutes)
    return (entities.join(_last(events, keys, ts), list(keys), "left")
            .withColumn("minutes_since", minutes_between("last_event", as_ts(as_of)))
            .withColumn("breach", F.when(F.col("last_event").isNull(), "never")
                        .when(F.col("minutes_since") > objective, "late"))
            .where(F.col("breach").isNotNull()))


def required_set_missing(instances: DataFrame, required: Sequence[dict], present: DataFrame,
                         keys: Sequence[str], version: str | None = None,
                         owner: Sequence[str] = ("instance_id",)) -> DataFrame:
    """Required items an instance lacks.

    ``required`` is a short list in code: each dict holds the key columns, optional payload
    and optional ``min_version``/``max_version`` (inclusive). It is expanded per instance from a
    literal array, so there is no cross join and no second table to ship.
    """
    names = sorted({n for item in required for n in item} - {"min_version", "max_version"})

    def item_struct(item: dict) -> Column:
        lo, hi = item.get("min_version"), item.get("max_version")
        return F.struct(*[F.lit(item.get(n)).alias(n) for n in names],
                        F.lit(lo).cast("double").alias("min_version"),
                        F.lit(hi).cast("double").alias("max_version"))

    wanted = instances.withColumn("_item", F.explode(F.array(*[item_struct(i) for i in required])))
    if version:
        wanted = wanted.where((F.col("_item.min_version").isNull() | (F.col(version) >= F.col("_item.min_version")))
                              & (F.col("_item.max_version").isNull() | (F.col(version) <= F.col("_item.max_version"))))
    wanted = wanted.select(*owner, *[F.col(f"_item.{n}").alias(n) for n in names])
    on = [*owner, *keys]
    return wanted.join(present.select(*on).distinct(), on, "left_anti")


def first_event(events: DataFrame, group: Sequence[str], ts: str, before=None) -> DataFrame:
    """Earliest event per group, kept when it is at or before ``before``."""
    first = events.groupBy(*group).agg(F.min(ts).alias("first_event"))
    return first if before is None else first.where(F.col("first_event") <= as_ts(before))


def recent_change(events: DataFrame, keys: Sequence[str], ts: str, window: str, as_of) -> DataFrame:
    """Keys whose last event is later than ``as_of - window``."""
    limit = as_ts(as_of) - F.expr(f"INTERVAL {window}")
    # The maximum is past the limit exactly when some event is, so older rows never leave the scan.
    return events.where(F.col(ts) > limit).groupBy(*keys).agg(F.max(ts).alias("last_event"))
