"""Reliability checks (6xx)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fold
from ..operators import (RowRule, SettingRule, compare_cols, group_heterogeneity, group_threshold, missing_coverage,
                         ownership_audit, rule_scan, settings_drift, settings_pair, settings_rules, snapshot_of, version_gate)
from ..operators.scope import LAST_SYSTEM_ID, TEMPDB_ID
from ..operators.versions import OLDEST_SUPPORTED, PATCHED_BUILDS, VERSION_NAMES
from ..schemas import LOCAL_SYSTEM_SID
from .facts import Facts, raw, text_for, union

UNLIMITED_MB = 2147483647
# File ceilings in 8 KB pages: 2 TB, and the log ceiling of the general purpose tier. Fixed values.
MAX_PAGES, GENERAL_PURPOSE_LOG_PAGES = 268435456, 15597568
# A maintenance database whose limited files are wanted, in key form: fixed value.
LIMITED_ON_PURPOSE = "db_administration"


def versions(f: Facts) -> DataFrame:
    """601, 602: builds with a security update, versions out of support; managed instances excepted."""
    own = f.instances.where(~F.col("is_managed") & F.col("major").isin([n for _, n in VERSION_NAMES]))
    name = text_for(F.col("major"), {n: t for t, n in VERSION_NAMES})
    behind = version_gate(own, PATCHED_BUILDS, "major", "build")
    return union(raw(behind, 601, None, name, "build"), raw(own.where(F.col("major") < OLDEST_SUPPORTED), 602, None, name, "major"))


def uptime(f: Facts) -> DataFrame:
    """603: tempdb, which is made at each start, is over 180 days old."""
    born = F.col("create_date")
    old = f.fleet["databases"].where((F.col("database_id") == TEMPDB_ID) & (born < f.params.ago("180 DAYS")))
    return raw(old, 603, None, F.date_format(born, "MM/dd/yyyy"))


def tempdb_on_c(f: Facts) -> DataFrame:
    """604 of the tempdb profile: files on C although tempdb has files elsewhere."""
    mixed = f.tempdb_files.groupBy("instance_id").agg(
        F.min(F.upper(F.substring("physical_name", 1, 1))).alias("lo"), F.max(F.upper(F.substring("physical_name", 1, 1))).alias("hi")).where("lo <> hi")
    on_c = f.tempdb_files.where(fold("physical_name").startswith("c:\\"))
    return raw(on_c.join(mixed, "instance_id", "left_semi"), 604, F.lit("tempdb"), "name")


def files(f: Facts) -> DataFrame:
    """604-607, 620, 630 in one scan of the files."""
    rows = f.files.join(f.other_drives, "instance_id", "left")
    tempdb, user = F.col("database_id") == TEMPDB_ID, F.col("database_id") > LAST_SYSTEM_ID
    elsewhere, name = F.col("other_drives") > 0, F.col("name")
    db, max_size = F.when(tempdb, "tempdb").otherwise(F.col("database_name")), F.col("max_size")
    return rule_scan(rows, [
        RowRule(604, tempdb & F.col("on_c") & elsewhere, db, name), RowRule(605, tempdb & (F.col("growth") == 0), db, name),
        RowRule(606, user & F.col("on_c") & elsewhere, db, name), RowRule(607, user & (F.col("growth") == 0), db, name),
        RowRule(620, ~tempdb & (F.col("growth") > 0) & ~max_size.isin(0, -1) & (max_size < MAX_PAGES)
                & F.col("type_desc").isin("ROWS", "LOG") & (fold("database_name") != LIMITED_ON_PURPOSE), db, name, F.floor(max_size / 128)),
        RowRule(630, user & (fold("name") == "master") & (fold("database_name") != "master"), db, name),
    ])


def tempdb_files(f: Facts) -> DataFrame:
    """605, 619 of the tempdb profile."""
    rows = f.tempdb_files.join(f.instances.select("instance_id", "service_tier"), "instance_id")
    ceiling = F.when(F.col("service_tier") == "GeneralPurpose", GENERAL_PURPOSE_LOG_PAGES).otherwise(MAX_PAGES)
    size, db, name = F.col("max_size"), F.lit("tempdb"), F.col("name")
    return rule_scan(rows, [
        RowRule(605, F.col("growth") == 0, db, name),
        RowRule(619, (F.col("growth") > 0) & ~size.isin(0, -1) & ((F.col("type") == 0) | ((F.col("type") == 1) & (size < ceiling))),
                db, name, F.floor(size / 128))])


def shared_drives(f: Facts) -> DataFrame:
    """608: data and log of one database on one drive, where there are two others than C."""
    rows = (f.files.where((F.col("database_id") > LAST_SYSTEM_ID) & (F.col("database_state") == 0) & (F.col("drive") != "C")
                          & F.col("type_desc").isin("ROWS", "LOG"))
            .join(f.other_drives.where("other_drives >= 2"), "instance_id", "left_semi"))
    mixed = group_heterogeneity(rows, ["instance_id", "database_name", "drive"], "type_desc")
    return raw(mixed.select("instance_id", "database_name").distinct(), 608, "database_name")


def jobs(f: Facts) -> DataFrame:
    """609-611: disabled schedules, no schedule, owned by a user."""
    on = f.fleet["jobs"].where("enabled").drop("snapshot_ts")
    links = f.fleet["job_schedules"].drop("snapshot_ts").join(
        f.fleet["schedules"].select("instance_id", "schedule_id", F.col("enabled").alias("schedule_on"), F.col("name").alias("schedule")),
        ["instance_id", "schedule_id"])
    off = on.join(links.where(~F.col("schedule_on")), ["instance_id", "job_id"])
    bare = missing_coverage(on, links.where(F.col("schedule_on").isNotNull()), ["instance_id", "job_id"])
    return union(raw(off, 609, None, F.concat_ws(" ", "name", "schedule")), raw(bare, 610, None, "name"), user_jobs(f))


def user_jobs(f: Facts) -> DataFrame:
    """611: enabled jobs whose owner is a known login other than the built-in administrator."""
    owned = ownership_audit(f.fleet["jobs"].where("enabled"), f.logins)
    theirs = owned.where(F.col("owner_known") & (F.col("owner_sid") != f.sa) & ~F.col("owner_name").startswith("##"))
    return raw(theirs, 611, None, F.concat_ws(" ", "name", "owner_name"))


def instance_rules(f: Facts) -> DataFrame:
    """612-614, 617, 621, 628 from instance rows."""
    rows = f.instances.join(f.other_drives.where("other_drives > 0"), "instance_id")

    def on_c(path: str):
        return F.upper(F.substring(path, 1, 1)) == "C"

    paths = rule_scan(rows, [RowRule(i, on_c(c), object=F.col(c)) for i, c in ((612, "data_path"), (613, "log_path"), (614, "backup_path"))])
    trial = (f.fleet["server_principals"].where(F.col("sid") == LOCAL_SYSTEM_SID)
             .join(f.instances.where(F.col("edition").ilike("%evaluation%")), "instance_id", "left_semi"))
    ends = F.date_format(F.col("create_date") + F.expr("INTERVAL 180 DAYS"), "yyyy-MM-dd")
    return union(paths, raw(trial, 621, None, ends), agent_offline(f))


def server_name(f: Facts) -> DataFrame:
    """617: the two server names differ."""
    differ = compare_cols(f.instances, fold("server_name_var"), fold("server_name_prop"))
    return raw(differ, 617, None, F.concat_ws(" ", "server_name_var", "server_name_prop"))


def agent_offline(f: Facts) -> DataFrame:
    """628: the Agent service is down, express editions excepted."""
    down = f.services.where((F.col("kind") == "agent") & (fold("status_desc") != "running"))
    wanted = f.instances.where(~F.col("edition").ilike("%xpress%"))
    return raw(down.join(wanted, "instance_id", "left_semi"), 628, None, F.concat_ws(" ", "servicename", "startup_type_desc"))


def settings(f: Facts) -> DataFrame:
    """615, 616, 626, 631: memory limits, pending changes, priority boost."""
    conf = f.fleet["configurations"]
    pair = settings_pair(conf, "min server memory (MB)", "max server memory (MB)")
    same = compare_cols(pair, F.col("first_value"), F.col("second_value"), equal=True)
    rules = settings_rules(conf, [SettingRule(616, "max server memory (MB)", "=", UNLIMITED_MB)])
    boost = conf.where((fold("name") == "priority boost") & ((F.col("value") == 1) | (F.col("value_in_use") == 1)))
    drift = settings_drift(conf, tolerated={"min server memory (MB)": (0, 16)})
    return union(raw(same, 615, None, None, "first_value"), rules, raw(boost, 631, None, "name"),
                 raw(drift, 626, None, F.concat_ws(" ", "name", "value_in_use", "value")))


def drive_space(f: Facts) -> DataFrame:
    """618: over ninety percent used."""
    return raw(f.drives.where("used_percent > 90.0"), 618, None, "drive", "used_percent")


def log_count(f: Facts, limit: int, default: int | None) -> DataFrame:
    """622: too few error logs are kept; without a default a missing value is not flagged."""
    kept = (f.fleet["registry_settings"].where("key = 'NumErrorLogs'")
            .groupBy("instance_id").agg(F.max(F.col("value").try_cast("double")).alias("kept")))
    rows = f.gate.select("instance_id").join(kept, "instance_id", "left")
    if default is not None:
        rows = rows.withColumn("kept", F.coalesce("kept", F.lit(float(default))))
    return raw(rows.where(F.col("kept") <= limit), 622, None, None, "kept")


def databases(f: Facts) -> DataFrame:
    """623 (one case per replication role), 627, 632 in one scan."""
    rows = f.databases.join(f.gate.select("instance_id", "major"), "instance_id")
    db, state = F.col("name"), F.col("state")
    level = F.col("compatibility_level")
    flags = ["is_published", "is_subscribed", "is_merge_published", "is_distributor"]
    return rule_scan(rows, [RowRule(623, F.col(c), db, case_no=i) for i, c in enumerate(flags)] + [
        RowRule(627, ~state.isin(0, 6), db, F.col("state_desc")),
        RowRule(632, (F.col("database_id") <= LAST_SYSTEM_ID) & (level < F.floor("major") * 10), db, metric=level)])


def memory(f: Facts) -> DataFrame:
    """624: less than one gigabyte available."""
    free = F.col("available_physical_kb")
    return raw(f.fleet["os_memory"].where(free < 1048576), 624, None, None, F.floor(free / 1024))


def snapshots(f: Facts) -> DataFrame:
    """625: snapshots with their source."""
    links = snapshot_of(f.databases, ["instance_id"], "source_database_id", "database_id", ["name"])
    return raw(links, 625, "name", F.concat_ws(" ", "source_name", F.date_format("create_date", "yyyy-MM-dd")))


def memory_dumps(f: Facts) -> DataFrame:
    """629: dumps of the last 90 days."""
    recent = f.fleet.between("memory_dumps", f.params.ago("90 DAYS"))
    per = group_threshold(recent, ["instance_id"], {"n": F.count(F.lit(1)), "last_at": F.max("creation_time")}, "n > 0")
    return raw(per, 629, None, F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"), "n")


def group_profile(f: Facts) -> list[DataFrame]:
    return [f.in_groups(server_name(f))]


def backup_profile(f: Facts) -> list[DataFrame]:
    return [agent_offline(f)]


def health_profile(f: Facts) -> list[DataFrame]:
    return [versions(f), uptime(f), files(f), shared_drives(f), f.only(jobs(f), "collected_as_sysadmin"), instance_rules(f), server_name(f),
            settings(f), drive_space(f), f.only(log_count(f, 6, None), "collected_as_sysadmin"), databases(f), memory(f), snapshots(f),
            memory_dumps(f)]


def security_profile(f: Facts) -> list[DataFrame]:
    return [versions(f), user_jobs(f), log_count(f, 7, 12)]


def tempdb_profile(f: Facts) -> list[DataFrame]:
    return [uptime(f), tempdb_on_c(f), tempdb_files(f)]


