"""Scoping (O31, O32): optional filters, eligible databases, and where a rule applies."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions import as_ts, fold


def scope(df: DataFrame, start: tuple[str, object] | None = None, end: tuple[str, object] | None = None,
          remap: dict[str, dict] | None = None, **filters) -> DataFrame:
    """A filter only for each value that is set, so unset ones cost nothing and keep nulls.

    Names compare without regard to case; ``remap`` translates what users type into stored codes.
    """
    for column, wanted in filters.items():
        if wanted is None:
            continue
        table = (remap or {}).get(column, {})
        if isinstance(wanted, str) and wanted in table:
            df = df.where(F.col(column) == table[wanted])  # a stored code: plain equality reaches the scan
        elif isinstance(wanted, str):
            df = df.where(fold(column) == wanted.lower())
        elif isinstance(wanted, Iterable):
            df = df.where(F.col(column).isin([table.get(w, w) for w in wanted]))
        else:
            df = df.where(F.col(column) == F.lit(table.get(wanted, wanted)))
    if start and start[1] is not None:
        df = df.where(F.col(start[0]) >= as_ts(start[1]))
    if end and end[1] is not None:
        df = df.where(F.col(end[0]) <= as_ts(end[1]))
    return df


# States of a database that is offline or restoring: fixed values.
NOT_AVAILABLE_STATES = (1, 6, 10)
TEMPDB_ID = 2
LAST_SYSTEM_ID = 4
MANAGED_EDITION = 8


def eligible_databases(databases: DataFrame, membership: DataFrame, instances: DataFrame) -> DataFrame:
    """Databases whose backups this instance answers for, with group columns added.

    Drops tempdb, offline or restoring, standby and snapshot databases; on managed instances the
    system databases too. ``preferred`` is null outside a group and counts as preferred.
    """
    # Availability groups exist from major version 11 on, and not on managed instances.
    gate = instances.select("instance_id", (F.col("engine_edition") == MANAGED_EDITION).alias("_managed"),
                            (F.col("major") >= 11).alias("_groups"))
    group = membership.select(F.col("instance_id").alias("_g_iid"), fold("database_name").alias("_g_db"),
                              "group_id", "group_name", "is_preferred_backup_replica")
    base = (databases.where((F.col("database_id") != TEMPDB_ID) & ~F.col("state").isin(*NOT_AVAILABLE_STATES)
                            & ~F.col("is_in_standby") & F.col("source_database_id").isNull())
            .withColumn("db_key", fold("name"))
            .join(gate, "instance_id"))
    capable = F.col("_groups") & ~F.col("_managed")
    base = base.where(capable | (F.col("database_id") > LAST_SYSTEM_ID))
    joined = base.join(group, capable & (F.col("instance_id") == F.col("_g_iid"))
                       & (F.col("db_key") == F.col("_g_db")), "left")
    return joined.drop("_managed", "_groups", "_g_iid", "_g_db")


def applicability(findings: DataFrame, instances: DataFrame, gates: dict[int, dict]) -> DataFrame:
    """Drop findings of rules that do not apply to the instance they came from.

    A gate may hold ``min_version``, ``max_version``, ``editions`` (engine editions that apply),
    ``not_editions`` and ``needs_sysadmin``. Rules without a gate pass.
    """
    allowed = F.lit(True)
    for check_id, gate in gates.items():
        ok = F.lit(True)
        if gate.get("min_version") is not None:
            ok = ok & (F.col("major") >= gate["min_version"])
        if gate.get("max_version") is not None:
            ok = ok & (F.col("major") <= gate["max_version"])
        if gate.get("editions"):
            ok = ok & F.col("engine_edition").isin(*gate["editions"])
        if gate.get("not_editions"):
            ok = ok & ~F.col("engine_edition").isin(*gate["not_editions"])
        if gate.get("needs_sysadmin"):
            ok = ok & F.col("collected_as_sysadmin")
        allowed = F.when(F.col("check_id") == check_id, ok).otherwise(allowed)
    facts = instances.select("instance_id", "major", "engine_edition", "collected_as_sysadmin")
    return (findings.join(facts, "instance_id").where(allowed)
            .drop("major", "engine_edition", "collected_as_sysadmin"))
