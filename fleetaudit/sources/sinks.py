"""Writers: snapshots and history as collectors ship them, and findings as history."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import as_ts
from .fleet import EVENT_FOLDERS, EVENT_TIME, event_folder


def write_snapshot(df: DataFrame, root: str, table: str, snapshot_ts, mode: str = "append") -> None:
    """One snapshot of a table under ``root/table``, partitioned by its date, clustered by instance
    so that row-group statistics prune reads of single instances."""
    at = as_ts(snapshot_ts)
    (df.withColumn("snapshot_ts", at).withColumn("snapshot_date", F.to_date(at))
     .sortWithinPartitions("instance_id")
     .write.mode(mode).partitionBy("snapshot_date").parquet(f"{root.rstrip('/')}/{table}"))


def _write_by_event(df: DataFrame, root: str, table: str, folder: str, snapshot_ts, mode: str) -> None:
    # Rows of a folder meet in few tasks, and a folder that holds most rows is split over several.
    (df.withColumn("snapshot_ts", as_ts(snapshot_ts)).hint("rebalance", folder).sortWithinPartitions(folder, "instance_id")
     .write.mode(mode).partitionBy(folder).parquet(f"{root.rstrip('/')}/{table}"))


def write_history(df: DataFrame, root: str, table: str, snapshot_ts, mode: str = "append", unit: str = "day") -> None:
    """Rows of a history table, each in the folder of its own time, however late it comes.

    ``unit`` is ``day``, or ``month`` for a fleet whose days would make small files; one table keeps to one unit.
    Rows without a time share a folder of their own.
    """
    folder = EVENT_FOLDERS[unit]
    _write_by_event(df.withColumn(folder, event_folder(unit, EVENT_TIME[table])), root, table, folder, snapshot_ts, mode)


def write_backup_history(sets: DataFrame, media: DataFrame, root: str, snapshot_ts, mode: str = "append", unit: str = "day") -> None:
    """Backup sets with the media they lie on.

    Media have no time of their own: each file is written once for every set shipped with it, into the folder of
    that set and under its number (``of_set_id``), so that both sides of their join are pruned alike. Media without a
    set are kept in the folder of those without a time.
    """
    write_history(sets, root, "backup_sets", snapshot_ts, mode, unit)
    folder = EVENT_FOLDERS[unit]
    owners = sets.select("instance_id", "media_set_id", F.col("backup_set_id").alias("of_set_id"),
                         event_folder(unit, EVENT_TIME["backup_sets"]).alias(folder))
    files = media.drop("of_set_id").join(owners, ["instance_id", "media_set_id"], "left")
    _write_by_event(files, root, "backup_media", folder, snapshot_ts, mode)


def write_findings(findings: DataFrame, path: str, as_of, run: str = "audit") -> None:
    """Findings as history: one folder per run date and run.

    A run that is written again, after a failure or on purpose, replaces its folder and no other. The
    header row of the report is always among the rows, so a rerun without findings replaces the old
    ones too. ``run`` names the run within its date, such as the profile.
    """
    (findings.withColumn("snapshot_date", F.to_date(as_ts(as_of))).withColumn("run", F.lit(run))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date", "run").parquet(path))


def read_findings(spark: SparkSession, path: str, since=None, run: str | None = None) -> DataFrame:
    """Findings of all runs, or of those from a date on, or of one name; only their folders are read."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.where(F.col("snapshot_date") >= F.to_date(as_ts(since)))
    return df if run is None else df.where(F.col("run") == run)
