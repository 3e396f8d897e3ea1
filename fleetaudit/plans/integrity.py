"""Integrity checks (5xx)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fold
from ..operators import group_threshold, required_set_missing
from ..operators.scope import applicability
from .facts import Facts, raw

# Alerts every instance needs: severities and read-error messages, fixed values.
ALERTS = ([{"severity": s, "message_id": 0} for s in range(19, 26)] + [{"severity": 0, "message_id": m} for m in (823, 824, 825)])


def page_verification(f: Facts) -> DataFrame:
    """501."""
    return raw(f.databases.where(f.online_user & (F.col("page_verify_option_desc") != "CHECKSUM")), 501, "name", "page_verify_option_desc")


def missing_alerts(f: Facts) -> DataFrame:
    """502: presence counts, enabled or not."""
    have = f.fleet["alerts"].select("instance_id", F.explode(F.array(
        F.struct(F.col("severity"), F.lit(0).alias("message_id")), F.struct(F.lit(0).alias("severity"), F.col("message_id")))).alias("a"))
    missing = required_set_missing(f.gate.select("instance_id"), ALERTS, have.select("instance_id", "a.*"), ["severity", "message_id"])
    what = F.when(F.col("severity") > 0, F.concat_ws(" ", F.lit("severity"), "severity")).otherwise(F.concat_ws(" ", F.lit("message"), "message_id"))
    return applicability(raw(missing, 502, None, what), f.instances, {502: {"editions": (2, 3, 8), "needs_sysadmin": True}})


def stale_integrity_checks(f: Facts) -> DataFrame:
    """503: the last good integrity check is over two weeks old."""
    dbs = f.databases.where((F.col("state") == 0) & F.col("source_database_id").isNull() & (F.col("updateability") == "READ_WRITE")
                            & ~F.col("is_read_only") & (F.col("db_key") != "tempdb"))
    last = (f.fleet["db_info"].where("field = 'dbi_dbccLastKnownGood'")
            .select("instance_id", fold("database_name").alias("db_key"), F.col("value").try_cast("timestamp_ntz").alias("checked"))
            .where(F.col("checked") < f.params.ago("14 DAYS")).distinct())
    return raw(dbs.select("instance_id", "db_key", "name").join(last, ["instance_id", "db_key"]), 503, "name",
               F.date_format("checked", "yyyy-MM-dd"))


def suspect_pages(f: Facts) -> DataFrame:
    """504 of the group profile: read errors per database of a group."""
    local = f.fleet["ag_databases"].where("is_local").select("instance_id", "database_id").distinct()
    hits = f.fleet["suspect_pages"].where(F.col("event_type").isin(1, 2, 3)).join(local, ["instance_id", "database_id"], "left_semi")
    return raw(_named(f, group_threshold(hits, ["instance_id", "database_id"], {
        "n": F.count(F.lit(1)), "errors": F.sum("error_count"), "last_at": F.max("last_update_date")}, "n > 0")),
        504, "database_name", F.concat_ws(" ", "errors", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss")), "n")


def recent_suspect_pages(f: Facts) -> DataFrame:
    """504 of the health profile: each page of the last 30 days."""
    recent = f.fleet.between("suspect_pages", f.params.ago("30 DAYS")).drop("snapshot_ts")
    names = f.databases.select("instance_id", "database_id", "name")
    return raw(recent.join(names, ["instance_id", "database_id"]), 504, "name", F.date_format("last_update_date", "yyyy-MM-dd HH:mm:ss"),
               "error_count")


def disabled_alerts(f: Facts) -> DataFrame:
    """505."""
    return f.only(raw(f.fleet["alerts"].where(~F.col("enabled")), 505, None, "name"), "collected_as_sysadmin")


def page_repairs(f: Facts) -> DataFrame:
    """506: repairs from another replica per database."""
    per = group_threshold(f.in_groups(f.fleet["page_repairs"]), ["instance_id", "database_id"], {
        "n": F.count(F.lit(1)), "last_at": F.max("modification_time")}, "n > 0")
    return raw(_named(f, per), 506, "database_name", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"), "n")


def _named(f: Facts, df: DataFrame) -> DataFrame:
    names = f.fleet["databases"].select("instance_id", "database_id", F.col("name").alias("database_name"))
    return df.join(names, ["instance_id", "database_id"], "left")


def group_profile(f: Facts) -> list[DataFrame]:
    return [suspect_pages(f), page_repairs(f)]


def backup_profile(f: Facts) -> list[DataFrame]:
    return [stale_integrity_checks(f)]


def health_profile(f: Facts) -> list[DataFrame]:
    return [page_verification(f), missing_alerts(f), stale_integrity_checks(f), recent_suspect_pages(f), disabled_alerts(f)]
