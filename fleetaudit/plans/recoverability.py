"""Recoverability checks (2xx)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import as_ts, fold, minutes_between
from ..operators import LogPattern, RowRule, SettingRule, first_event, group_heterogeneity, log_extract, rule_scan, settings_rules
from .facts import BACKUP_TYPES, Facts, raw, text_for, union


def settings(f: Facts, checksum_since: float | None = None) -> DataFrame:
    """208, 209: compression and checksum defaults are off. The backup profile tests 209 past version 11 only."""
    since = (checksum_since, None)
    rules = [SettingRule(208, "backup compression", "=", 0), SettingRule(208, "backup compression default", "=", 0),
             SettingRule(209, "backup checksum", "=", 0, versions=since),
             SettingRule(209, "backup checksum default", "=", 0, versions=since)]
    settings = f.fleet["configurations"].join(f.gate.select("instance_id", "major"), "instance_id")
    return settings_rules(settings, rules, version="major")


def coverage(f: Facts) -> DataFrame:
    """203-206 and 214 from one row per eligible database."""
    p, logged = f.params, F.col("recovery_model_desc") != "SIMPLE"
    preferred = F.coalesce("is_preferred_backup_replica", F.lit(True))
    full, log, name = F.col("last_full"), F.col("last_log"), F.col("name")
    late = minutes_between("last_any", p.now)
    rules = [
        RowRule(203, preferred & full.isNull(), name),
        RowRule(204, preferred & logged & log.isNull(), name),
        RowRule(205, preferred & (full <= p.ago("7 DAYS")), name),
        RowRule(206, preferred & logged & (log <= p.ago("24 HOURS")), name),
    ]
    if p.objective_minutes is not None:
        rules += [RowRule(214, late > p.objective_minutes, name, metric=late),
                  RowRule(214, F.col("last_any").isNull(), name, case_no=1)]
    return rule_scan(f.backup_coverage, rules)


def history_rules(f: Facts) -> DataFrame:
    """202, 215 and 218 from one aggregate per database over the file history."""
    nul = F.upper(F.trim("physical_device_name")).isin("NUL", "NUL:")
    own = ~F.col("is_copy_only")
    to_nul = (F.col("type") == "L") & own & nul
    per_db = (f.history.join(f.gate.select("instance_id", "major"), "instance_id")
              .groupBy("instance_id", "database_name")
              .agg(F.max("major").alias("major"),
                   F.count_if(own & ~F.col("has_backup_checksums")).alias("unchecked"),
                   F.bool_or("is_password_protected").alias("protected"),
                   F.count_if(to_nul).alias("nul_backups"),
                   F.max(F.when(to_nul, F.col("backup_start_date"))).alias("last_nul")))
    db = F.col("database_name")
    return rule_scan(per_db, [
        RowRule(202, (F.col("unchecked") > 0) & (F.col("major") > 11), db, metric=F.col("unchecked")),
        RowRule(215, F.col("protected") & (F.col("major") < 11), db),
        RowRule(218, F.col("nul_backups") > 0, db, F.date_format("last_nul", "yyyy-MM-dd HH:mm:ss"), F.col("nul_backups")),
    ])


def split_chains(f: Facts) -> DataFrame:
    """201: backups of one type in more than one location."""
    own = f.backup_locations.where(~F.col("is_copy_only"))
    split = group_heterogeneity(own, ["instance_id", "database_name", "type"], "location", count=True)
    return raw(split, 201, "database_name", text_for(F.col("type"), BACKUP_TYPES), "distinct_values")


def failed_backups(f: Facts, in_range: bool) -> DataFrame:
    """207: failed backup lines with the database they name."""
    log = f.fleet.between("error_log", f.params.range_start, f.params.range_end) if in_range else f.fleet["error_log"]
    log = log.where(F.col("message").ilike("%BACKUP failed to complete the command BACKUP%"))
    rows = log_extract(log, [
        LogPattern("database", "BACKUP DATABASE ", r"(?s)^(.*?BACKUP DATABASE ([^.]+)\.)", ("issue", "name")),
        LogPattern("log", "BACKUP LOG ", r"(?s)^(.*?BACKUP LOG ([^.]+)\.)", ("issue", "name")),
    ], distinct=True)
    rows = rows.withColumn("name", F.translate("name", "[]", "")).withColumn("on", F.date_format("log_date", "MM/dd/yyyy"))
    if f.params.database_name:
        rows = rows.where(fold("name") == f.params.database_name.lower())
    return raw(rows, 207, "name", F.concat_ws(" ", "on", "issue"))


def certificates(f: Facts) -> DataFrame:
    """210-213: certificates of backups and of encrypted databases: never saved, saved long ago, expiring."""
    p = f.params
    certs = f.fleet["certificates"].drop("snapshot_ts").withColumnRenamed("name", "certificate")
    expires_in = F.datediff(F.col("expiry_date"), p.now)
    saved = F.col("pvt_key_last_backup_date")

    def rules(backup_id: int, expiry_id: int, db) -> list[RowRule]:
        cert = F.col("certificate")
        return [RowRule(backup_id, saved.isNull(), db, cert), RowRule(backup_id, saved <= p.ago("90 DAYS"), db, cert, case_no=1),
                RowRule(expiry_id, f.within("expiry_date"), db, cert, expires_in)]

    # Databases per thumbprint are made distinct before the join: history has many sets per database.
    backed = (f.fleet["backup_sets"].where(F.col("encryptor_thumbprint").isNotNull())
              .select("instance_id", "database_name", F.col("encryptor_thumbprint").alias("thumbprint")).distinct())
    used = f.only(backed.join(certs, ["instance_id", "thumbprint"]), "major >= 12")
    of_backups = rule_scan(used, rules(210, 212, F.col("database_name")))

    names = f.fleet["databases"].select("instance_id", "database_id", F.col("name").alias("database_name"))
    keyed = (f.fleet["encryption_keys"].select("instance_id", "database_id", F.col("encryptor_thumbprint").alias("thumbprint"))
             .join(certs, ["instance_id", "thumbprint"]).join(names, ["instance_id", "database_id"], "left"))
    return union(of_backups, rule_scan(keyed, rules(211, 213, F.col("database_name"))))


def unpurged_history(f: Facts) -> DataFrame:
    """216: the oldest backup is 90 days old or more."""
    first = first_event(f.fleet["backup_sets"], ["instance_id"], "backup_start_date", f.params.ago("90 DAYS"))
    return raw(first, 216, None, F.date_format("first_event", "yyyy-MM-dd HH:mm:ss"), F.datediff(as_ts(f.params.as_of), "first_event"))


def log_fragments(f: Facts, writable_only: bool) -> DataFrame:
    """217: more than 200 virtual log files, from version 13 on."""
    dbs = f.databases
    if writable_only:
        dbs = dbs.where((F.col("state") == 0) & F.col("source_database_id").isNull() & ~F.col("is_in_standby")
                        & (F.col("updateability") == "READ_WRITE"))
    stats = f.fleet["db_log_stats"].where("total_vlf_count > 200").drop("snapshot_ts")
    hit = f.only(dbs.select("instance_id", "database_id", "name").join(stats, ["instance_id", "database_id"]), "major >= 13")
    return raw(hit, 217, "name", None, "total_vlf_count")


def backup_profile(f: Facts) -> list[DataFrame]:
    return [settings(f, 11.1), coverage(f), history_rules(f), split_chains(f), failed_backups(f, True),
            certificates(f), unpurged_history(f), log_fragments(f, True)]


def health_profile(f: Facts) -> list[DataFrame]:
    return [settings(f), rule_subset(coverage(f), (203, 204, 205, 206)), failed_backups(f, False), certificates(f),
            unpurged_history(f), log_fragments(f, False)]


def security_profile(f: Facts) -> list[DataFrame]:
    return [certificates(f)]


def rule_subset(findings: DataFrame, ids) -> DataFrame:
    return findings.where(F.col("check_id").isin(*ids))


