"""Start and end events of one key."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import epoch_micros, millis_between


def _instants(events: DataFrame, keys: Sequence[str], ts: str, start: Column, end: Column, bucket: str) -> DataFrame:
    """Distinct instants per key with ``starts`` (how many start there) and ``end_at``, the first strictly
    later end.

    Rows of one key and instant meet in a partial aggregate, before any shuffle. The instants are then
    split by key *and* time bucket, so no task holds more than the instants of one bucket, however many
    rows a key or a moment has. Inside a bucket a descending frame gives the next end in one linear pass;
    an instant with no later end there takes the first end of the next bucket that has one, found on a
    table with one row per key and bucket.
    """
    width = F.expr(f"unix_micros(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {bucket})")
    moments = (events.where(start | end)
               .groupBy(*keys, ts).agg(F.count_if(start).alias("starts"), F.bool_or(end).alias("_has_end"))
               .withColumn("_us", epoch_micros(ts))
               .withColumn("_bucket", F.floor(F.col("_us") / width).cast("long"))
               .withColumn("_end", F.when(F.col("_has_end"), F.col(ts))))
    by = [*keys, "_bucket"]
    inside = Window.partitionBy(*by).orderBy(F.desc("_us")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = (moments.groupBy(*by).agg(F.min("_end").alias("_first"))
               .withColumn("_far", F.min("_first").over(later)).drop("_first"))
    near = moments.withColumn("_near", F.min("_end").over(inside)).where("starts > 0")
    return near.join(buckets, by, "left").select(*keys, ts, "starts", F.coalesce("_near", "_far").alias("end_at"))


def next_event_pairing(events: DataFrame, keys: Sequence[str], ts: str, start: Column, end: Column,
                       bucket: str = "1 minute", keep_unmatched: bool = False) -> DataFrame:
    """Each start row with ``end_at``, the first strictly later end of its key, and ``duration_ms``."""
    found = _instants(events, keys, ts, start, end, bucket).drop("starts")
    paired = (events.where(start).join(found, [*keys, ts], "left" if keep_unmatched else "inner")
              .withColumn("duration_ms", millis_between(ts, "end_at")))
    return paired if keep_unmatched else paired.where(F.col("end_at").isNotNull())


def pairing_summary(events: DataFrame, keys: Sequence[str], ts: str, start: Column, end: Column,
                    bucket: str = "1 minute") -> DataFrame:
    """Number, total and average duration of pairs per key, from the instants alone: the start rows
    themselves are never joined back."""
    ms = millis_between(ts, "end_at")
    found = _instants(events, keys, ts, start, end, bucket).where(F.col("end_at").isNotNull())
    return (found.groupBy(*keys).agg(F.sum("starts").alias("pairs"), F.sum(ms * F.col("starts")).alias("total_ms"))
            .withColumn("avg_ms", F.col("total_ms") / F.col("pairs")))
