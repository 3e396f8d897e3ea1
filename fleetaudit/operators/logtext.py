"""Text sources (O12, O29): log lines and event payloads."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import fold


@dataclass(frozen=True)
class LogPattern:
    """Lines that contain ``contains`` and match ``pattern``; group i feeds ``fields[i-1]``."""
    kind: str
    contains: str
    pattern: str
    fields: Sequence[str] = field(default_factory=tuple)


def log_extract(log: DataFrame, patterns: Sequence[LogPattern], message: str = "message",
                keep: Sequence[str] = ("instance_id", "log_date"), distinct: bool = False) -> DataFrame:
    """One pass over the log for several patterns.

    The plain ``contains`` test, which the scan can apply to cheap bytes, goes first; the regex
    runs on the few lines left. ``kind`` tells which pattern matched; the first one wins.
    """
    lower = fold(message)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | lower.contains(p.contains.lower())
    kind, names = None, []
    for p in patterns:
        test = lower.contains(p.contains.lower()) & F.col(message).rlike("(?i)" + p.pattern)
        kind = F.when(test, p.kind) if kind is None else kind.when(test, p.kind)
        names += [f for f in p.fields if f not in names]
    rows = log.where(hit).withColumn("kind", kind).where(F.col("kind").isNotNull())
    out = [*keep, "kind"]
    for name in names:
        value = None
        for p in patterns:
            if name in p.fields:
                got = F.regexp_extract(F.col(message), "(?i)" + p.pattern, list(p.fields).index(name) + 1)
                value = F.when(F.col("kind") == p.kind, got) if value is None else value.when(F.col("kind") == p.kind, got)
        out.append(F.trim(value).alias(name))
    rows = rows.select(*out)
    return rows.distinct() if distinct else rows


# Shape of an event payload: attributes carry an underscore.
_EVENT = "_timestamp string, data array<struct<_name string, value string, text string>>"


def state_changes(events: DataFrame, instances: DataFrame, payload: str = "event_data",
                  object_name: str = "availability_replica_state_change") -> DataFrame:
    """Time (shifted to the instance's local time), group, previous and current state from XML.

    The payload is parsed once per event; one that is not well-formed gives nulls, not a failed job.
    Events of instances not listed are left out.
    """
    def data(name: str, leaf: str):
        named = F.filter(F.col("_e.data"), lambda d: d["_name"] == name)
        return F.try_element_at(named, F.lit(1))[leaf]

    parsed = (events.where(F.col("object_name") == object_name)
              .select("instance_id", "object_name", F.from_xml(payload, _EVENT).alias("_e")))
    utc = F.regexp_replace(F.regexp_replace(F.col("_e._timestamp"), "T", " "), "Z$", "").try_cast("timestamp_ntz")
    local = utc + F.make_dt_interval(mins=F.coalesce(F.col("utc_offset_minutes"), F.lit(0)))
    return (parsed.join(instances.select("instance_id", "utc_offset_minutes"), "instance_id")
            .select("instance_id", "object_name", local.alias("event_time"),
                    data("availability_group_name", "value").alias("group_name"),
                    data("previous_state", "text").alias("previous_state"),
                    data("current_state", "text").alias("current_state")))
