"""Access to the fleet's tables: declared types, one snapshot per instance, lazily read."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ..functions import as_ts
from ..functions.stage import staged
from ..schemas import COLUMNS, schema_of

# Tables that only grow, with the time of their rows: a snapshot filter would drop history.
EVENT_TIME = {"backup_sets": "backup_start_date", "backup_media": None, "restore_history": "restore_date", "error_log": "log_date",
              "xe_events": None, "suspect_pages": "last_update_date", "page_repairs": "modification_time", "memory_dumps": "creation_time"}
# Folders that history may be laid out by, with the first day of the folder a time falls into.
EVENT_FOLDERS = {"day": "event_date", "month": "event_month"}


def event_folder(unit: str, time) -> Column:
    """The day or the first day of the month of a time."""
    day = F.to_date(time)
    return day if unit == "day" else F.trunc(day, "month").cast("date")


def align(df: DataFrame, table: str) -> DataFrame:
    """Declared columns in declared types; a column an older collector lacks becomes a typed null,
    so rules on it stay silent."""
    have = {c.lower(): c for c in df.columns}

    def column(name: str, kind: str) -> str:
        source = f"`{have[name]}`" if name in have else "NULL"
        return f"CAST({source} AS {kind}) AS {name}"

    return df.selectExpr(*[column(f.name, f.dataType.simpleString()) for f in schema_of(table).fields])


def in_range(df: DataFrame, table: str, start=None, end=None) -> DataFrame:
    """Rows of a history table from ``start`` to ``end``, both included; a bound that is None does not apply.

    The filter on the rows' time is repeated on the folders that the lake lays history out by, so only
    those of the range are read. A row lies in the folder of its own time whenever it arrived, so
    late rows are found. Folders by collection date are cut below only (a day of slack for clocks): nothing is
    collected before it happens. Rows outside such a layout, and times that are null there, have a null
    folder and are left to the row filter; the media of a backup have no time but that of their folder.
    """
    for bound, keeps in ((start, "__ge__"), (end, "__le__")):
        if bound is None:
            continue
        at = as_ts(bound)
        if EVENT_TIME[table]:
            df = df.where(getattr(F.col(EVENT_TIME[table]), keeps)(at))
        for unit, folder in EVENT_FOLDERS.items():
            if folder in df.columns:
                df = df.where(F.col(folder).isNull() | getattr(F.col(folder), keeps)(event_folder(unit, at)))
        if keeps == "__ge__" and "snapshot_date" in df.columns:
            df = df.where(F.col("snapshot_date").isNull() | (F.col("snapshot_date") >= F.date_sub(F.to_date(at), 1)))
    return df


def latest_snapshot(df: DataFrame, as_of=None, lookback_days: int | None = None, resolve_once: bool = False) -> DataFrame:
    """Rows of each instance's last snapshot at or before ``as_of``.

    The last time per instance comes from two columns and combines on the map side; the rows are
    then kept by a semi join on (instance, time). Folders of ``snapshot_date`` after ``as_of`` are pruned;
    with ``lookback_days`` those before the window too, and an instance silent for longer is not read.
    With ``resolve_once`` the last times are written, and of the folders only those that hold one are read.
    """
    if as_of is not None:
        df = df.where(F.col("snapshot_ts") <= as_ts(as_of))
        if "snapshot_date" in df.columns:
            day = F.to_date(as_ts(as_of))
            df = df.where(F.col("snapshot_date") <= day)
            if lookback_days is not None:
                df = df.where(F.col("snapshot_date") >= F.date_sub(day, lookback_days))
    last = df.groupBy("instance_id").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    if resolve_once:
        last = staged(last, "last-snapshots")
        if "snapshot_date" in df.columns:
            # As many days as there are folders at most. Rows outside the layout have no day.
            days = [r[0] for r in last.where("snapshot_ts IS NOT NULL").select(F.to_date("snapshot_ts")).distinct().collect()]
            df = df.where(F.col("snapshot_date").isin(days) | F.col("snapshot_date").isNull())
    return df.join(last, ["instance_id", "snapshot_ts"], "left_semi")


class Fleet:
    """Fleet tables by name. Each is built once on first use and kept as a lazy DataFrame.

    Tables named in ``stage`` are costly to derive and are written to the shared folder on first use.
    """

    def __init__(self, spark: SparkSession, reader: Callable[[str], DataFrame | None], stage: Sequence[str] = ()):
        self.spark, self._reader, self._stage = spark, reader, frozenset(stage)
        self._sources, self._tables, self._absent = {}, {}, set()

    def _read(self, table: str) -> DataFrame:
        if table not in COLUMNS:
            raise KeyError(table)
        if table not in self._sources:
            df = self._reader(table)
            if df is None:
                self._absent.add(table)
                df = self.spark.range(1).where(F.lit(False))  # folds to an empty relation
            self._sources[table] = df
        return self._sources[table]

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._tables:
            source = self._read(table)
            df = align(source, table)
            self._tables[table] = staged(df, table) if table in self._stage and table not in self._absent else df
        return self._tables[table]

    def between(self, table: str, start=None, end=None) -> DataFrame:
        """A history table in a range of times, read from the folders of the range only (``in_range``)."""
        if table in self._stage:
            return in_range(self[table], table, start, end)
        source = self._read(table)
        time = EVENT_TIME[table]
        if source.columns and (time is None or time in source.columns):
            return align(in_range(source, table, start, end), table)
        return in_range(self[table], table, start, end)  # an older collector's table, or none

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: dict[str, DataFrame]) -> "Fleet":
        return cls(spark, frames.get)

    @classmethod
    def from_lake(cls, spark: SparkSession, root: str, as_of=None, lookback_days: int | None = None,
                  fmt: str = "parquet", resolve_once: bool = False) -> "Fleet":
        """Tables under ``root/<table>``; snapshot tables are partitioned by ``snapshot_date``, history by
        ``event_date`` or ``event_month``.

        A table without a folder counts as not collected and is empty. Parquet is read with the declared
        columns, so a file that lacks one gives nulls there, a narrower type is widened, and no column of
        a newer file is lost. Other formats keep their own schema and are cast.

        With ``resolve_once`` the snapshot of each table is looked up and written on first use, for runs in
        which many rules read a table: every later reading is one plain scan of the current rows.
        """
        def read(table: str) -> DataFrame | None:
            try:
                source = spark.read.format(fmt)
                if fmt == "parquet":
                    declared = schema_of(table)
                    source = source.schema(StructType([*declared.fields, *(StructField(c, DateType()) for c in ("snapshot_date", *EVENT_FOLDERS.values()))]))
                df = source.load(f"{root.rstrip('/')}/{table}")
            except AnalysisException as e:
                if e.getCondition() == "PATH_NOT_FOUND":
                    return None
                raise
            if table in EVENT_TIME:
                return df
            return latest_snapshot(df, as_of, lookback_days, resolve_once)

        return cls(spark, read, [t for t in COLUMNS if t not in EVENT_TIME] if resolve_once else ())
