"""Performance checks (7xx)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fold
from ..operators import RowRule, SettingRule, required_set_missing, rule_scan, settings_rules
from ..operators.scope import TEMPDB_ID
from .facts import Facts, raw, text_for, union

# Growth below 64 MB and a log above 100 MB, in 8 KB pages; the best power plan. Fixed values.
SMALL_GROWTH_PAGES, LARGE_LOG_PAGES = 8191, 12800
HIGH_PERFORMANCE = "8c5e7fda-e8bf-4a96-9a85-a6e23a8c635c"
POWER_PLANS = {"a1841308-3541-4fab-bc81-f71556f20b4a": "power saving", "381b4222-f694-41f0-9685-ff5bb260df2e": "balanced power"}
KNOWN_SESSIONS = ("alwayson_health", "system_health", "telemetry_xevents", "sp_server_diagnostics",
                  "sp_server_diagnostics session", "hkenginexesession")


def settings(f: Facts) -> DataFrame:
    """701, 702: parallelism settings at their defaults or off."""
    return settings_rules(f.fleet["configurations"], [
        SettingRule(701, "cost threshold for parallelism", "=", 5), SettingRule(702, "max degree of parallelism", "=", 0),
        SettingRule(702, "max degree of parallelism", "=", 1, case_no=1)])


def memory_optimized_tempdb(f: Facts) -> DataFrame:
    """717, from version 15 on."""
    conf = f.fleet["configurations"].join(f.gate.select("instance_id", "major"), "instance_id")
    return settings_rules(conf, [SettingRule(717, "tempdb metadata memory-optimized", "=", 1, versions=(15, None))], version="major")


def databases(f: Facts) -> DataFrame:
    """703-705, 728, 734-737, 740 over the online user databases, in one scan."""
    rows = f.databases.where(f.online_user).join(f.gate.select("instance_id", "major"), "instance_id")
    db, level = F.col("name"), F.col("compatibility_level")
    on = {703: "is_auto_shrink_on", 704: "is_auto_close_on", 734: "is_recursive_triggers_on", 735: "is_parameterization_forced",
          736: "is_cdc_enabled"}
    off = {728: "is_auto_create_stats_on", 740: "is_auto_update_stats_on"}
    return rule_scan(rows, [RowRule(i, F.col(c), db) for i, c in on.items()] + [RowRule(i, ~F.col(c), db) for i, c in off.items()] + [
        RowRule(705, level < F.col("major") * 10, db, metric=level), RowRule(737, F.col("delayed_durability") != 0, db)])


def trace_flags(f: Facts, ids: tuple[int, ...], spare_managed: bool) -> DataFrame:
    """706, 715, 716: flags an instance of that version should run with."""
    required = [{"check_id": 706, "trace_flag": "2371", "max_version": 12.9}, {"check_id": 706, "trace_flag": "7752", "min_version": 13, "max_version": 14.9},
                {"check_id": 706, "trace_flag": "7745", "min_version": 13}, {"check_id": 706, "trace_flag": "3226"},
                {"check_id": 715, "trace_flag": "1117", "max_version": 12.9}, {"check_id": 716, "trace_flag": "1118", "max_version": 12.9}]
    who = f.gate.where(~F.col("is_managed")) if spare_managed else f.gate
    gone = required_set_missing(who.select("instance_id", "major"), [r for r in required if r["check_id"] in ids], f.fleet["trace_flags"],
                                ["trace_flag"], "major")
    return gone.select("instance_id", "check_id", F.lit(0).alias("case_no"), F.lit(None).cast("string").alias("database_name"),
                       F.col("trace_flag").alias("object_name"), F.lit(None).cast("double").alias("metric"))


def tempdb_layout(f: Facts, spare_managed: bool) -> DataFrame:
    """707-710, 713, 730 from one two-step aggregate: per file group, then per instance."""
    size, pair = F.col("size"), F.struct("growth", "is_percent_growth")
    part = f.tempdb_files.groupBy("instance_id", "type", "data_space_id").agg(
        F.count("file_id").alias("n"), F.sum(size).alias("pages"), F.min(size).alias("lo"), F.max(size).alias("hi"),
        (F.min(pair) != F.max(pair)).alias("uneven"))
    data, log = F.col("type") == 0, F.col("type") == 1

    def total(kind: Column, c: str) -> Column:
        return F.sum(F.when(kind, F.col(c)))

    rows = (part.groupBy("instance_id").agg(
        F.coalesce(total(data, "n"), F.lit(0)).alias("data_files"), F.coalesce(total(log, "n"), F.lit(0)).alias("log_files"),
        F.min(F.when(data, F.col("lo"))).alias("lo"), F.max(F.when(data, F.col("hi"))).alias("hi"),
        F.bool_or(data & F.col("uneven")).alias("uneven"), total(data, "pages").alias("data_pages"), total(log, "pages").alias("log_pages"))
        .join(f.instances.select("instance_id", "cpu_count", "is_managed"), "instance_id"))
    db, n = F.lit("tempdb"), F.col("data_files")
    counted = ~F.col("is_managed") if spare_managed else F.lit(True)
    return rule_scan(rows, [
        RowRule(707, counted & (n != F.least("cpu_count", F.lit(8))), db, F.concat_ws(" ", "cpu_count", F.lit("cores")), n),
        RowRule(708, F.col("lo") != F.col("hi"), db), RowRule(709, F.col("uneven"), db),
        RowRule(710, F.col("log_pages") > F.col("data_pages"), db), RowRule(713, F.col("log_files") > 1, db, metric=F.col("log_files")),
        RowRule(730, n > 16, db, metric=n)])


def tempdb_files(f: Facts) -> DataFrame:
    """711, 712, 714 in one scan of the tempdb files."""
    db, name, percent = F.lit("tempdb"), F.col("name"), F.col("is_percent_growth")
    used = F.col("space_used").cast("double") / F.nullif(F.col("size").cast("double"), F.lit(0.0)) * 100
    return rule_scan(f.tempdb_files, [
        RowRule(711, percent, db, name), RowRule(712, ~percent & F.col("growth").between(1, SMALL_GROWTH_PAGES), db, name, F.col("growth")),
        RowRule(714, used > f.params.usage_percent, db, name)])


def tempdb_stalls(f: Facts) -> DataFrame:
    """718, 719: slow reads and writes."""
    db, name, read, write = F.lit("tempdb"), F.col("name"), F.col("read_stall_ms"), F.col("write_stall_ms")
    return rule_scan(f.tempdb_stalls, [RowRule(718, read > f.params.read_stall_ms, db, name, read),
                                       RowRule(719, write > f.params.write_stall_ms, db, name, write)])


def files(f: Facts) -> DataFrame:
    """720-723: logs larger than data, growth rates and log counts outside tempdb; one aggregate per
    database and one scan of the files."""
    other = f.files.where(F.col("database_id") != TEMPDB_ID)
    log, db, name, percent = F.col("type") == 1, F.col("database_name"), F.col("name"), F.col("is_percent_growth")
    per_db = other.groupBy("instance_id", "database_id", "database_name").agg(
        F.sum(F.when(log, F.col("size"))).alias("log_pages"), F.sum(F.when(F.col("type") == 0, F.col("size"))).alias("data_pages"),
        F.count_if(F.col("type_desc") == "LOG").alias("log_files"))
    pages = F.col("log_pages")
    sized = rule_scan(per_db, [
        RowRule(720, db.isNotNull() & (pages > F.col("data_pages")) & (pages > LARGE_LOG_PAGES), db, metric=pages),
        RowRule(723, F.col("log_files") > 1, db, metric=F.col("log_files"))])
    grown = rule_scan(other.where(F.col("type").isin(0, 1)), [
        RowRule(721, percent, db, name),
        RowRule(722, ~percent & F.col("growth").between(1, SMALL_GROWTH_PAGES) & ~F.col("database_id").isin(1, 4), db, name, F.col("growth"))])
    return union(sized, grown)


def power_plan(f: Facts) -> DataFrame:
    """724: the plan set by policy, else the local one, is not the fast one."""
    key = F.col("key")
    plan = (f.fleet["registry_settings"].where(key.isin("PolicyPowerScheme", "LocalPowerScheme")).groupBy("instance_id")
            .agg(F.coalesce(F.max(F.when(key == "PolicyPowerScheme", F.col("value"))),
                            F.max(F.when(key == "LocalPowerScheme", F.col("value")))).alias("plan")))
    slow = plan.where(fold("plan") != HIGH_PERFORMANCE)
    return f.only(raw(slow, 724, None, text_for(fold("plan"), POWER_PLANS, "an unknown power mode")), "collected_as_sysadmin")


def instant_initialization(f: Facts) -> DataFrame:
    """725: off by the service's own flag, or, where that is not exported, by the lack of the log line."""
    engine = f.services.where(F.col("kind") == "engine").select("instance_id", "instant_file_initialization_enabled")
    rows = engine.join(f.log_facts.select("instance_id", "instant_init"), "instance_id", "left")
    flag = F.coalesce("instant_file_initialization_enabled", F.when(F.col("instant_init"), "Y").when(~F.col("instant_init"), "N"))
    return raw(rows.where(flag == "N"), 725)


def memory(f: Facts) -> DataFrame:
    """726, 742: pages locked in memory, alone and with no memory limit."""
    limit = (f.fleet["configurations"].where(fold("name") == "max server memory (mb)")
             .groupBy("instance_id").agg(F.max("value_in_use").alias("max_memory")))
    locked = f.fleet["os_memory"].where("locked_page_kb > 0").join(limit, "instance_id", "left")
    kb = F.col("locked_page_kb")
    size = F.when(kb >= 1048576, F.concat_ws(" ", F.floor(kb / 1048576), F.lit("GB"))).otherwise(F.concat_ws(" ", F.floor(kb / 1024), F.lit("MB")))
    return rule_scan(locked, [RowRule(726, kb > 0, object=size, metric=kb),
                              RowRule(742, F.col("max_memory") == 2147483647, object=size, metric=kb)])


def resource_limits(f: Facts) -> DataFrame:
    """727: workload groups limited in tempdb, in MB (case 0) or percent (case 1), from version 17 on."""
    on = f.fleet["resource_governor"].where("is_enabled").select("instance_id")
    groups = (f.fleet["rg_groups"].drop("snapshot_ts").join(f.fleet["rg_pools"].drop("snapshot_ts"), ["instance_id", "pool_id"])
              .join(on, "instance_id", "left_semi"))
    what, mb, pct = F.concat_ws(" ", "group_name", "pool_name"), F.col("max_tempdb_mb"), F.col("max_tempdb_percent")
    return f.only(rule_scan(groups, [RowRule(727, mb.isNotNull(), F.lit("tempdb"), what, mb),
                                     RowRule(727, pct.isNotNull(), F.lit("tempdb"), what, pct, 1)]), "major >= 17")


def accelerated_recovery(f: Facts) -> DataFrame:
    """741, from version 17 on."""
    on = f.fleet["databases"].where((F.col("database_id") == TEMPDB_ID) & F.col("is_accelerated_database_recovery_on"))
    return f.only(raw(on, 741, "name"), "major >= 17")


def schedulers(f: Facts) -> DataFrame:
    """729: offline schedulers per node."""
    off = (f.fleet["cpu_schedulers"].where("status = 'VISIBLE OFFLINE'")
           .groupBy("instance_id", F.col("parent_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n")))
    nodes = f.fleet["cpu_nodes"].where(F.col("memory_node_id").isNotNull() & ~fold("node_state_desc").contains("dac"))
    return raw(nodes.join(off, ["instance_id", "node_id"]), 729, None, F.concat_ws(" ", F.lit("node"), "node_id"), "n")


def features(f: Facts) -> DataFrame:
    """731-733, 738: features that cost."""
    governor = f.fleet["resource_governor"].where("is_enabled")
    triggers = f.fleet["server_triggers"].where(~F.col("is_disabled") & ~F.col("is_ms_shipped") & ~fold("name").startswith("rds_"))
    tracked = f.fleet["change_tracking"].drop("snapshot_ts").join(f.databases.select("instance_id", "database_id", "name"), ["instance_id", "database_id"])
    sessions = f.fleet["xe_sessions"].where(~fold("name").isin(*KNOWN_SESSIONS) & ~fold("name").contains("$a$"))
    return union(raw(governor, 731), raw(triggers, 732, None, "name"), raw(tracked, 733, "name"), raw(sessions, 738, None, "name"))


def freezes(f: Facts) -> DataFrame:
    """739: frozen I/O per database: number and average milliseconds."""
    return raw(f.freezes, 739, "db_key", F.concat_ws(" ", "pairs", F.lit("freezes")), "avg_ms")


def backup_profile(f: Facts) -> list[DataFrame]:
    return [freezes(f)]


def health_profile(f: Facts) -> list[DataFrame]:
    return [settings(f), memory_optimized_tempdb(f), databases(f), trace_flags(f, (706, 715, 716), False),
            tempdb_layout(f, False).where("check_id <> 730"), tempdb_files(f), tempdb_stalls(f), files(f), power_plan(f),
            instant_initialization(f), memory(f), schedulers(f), features(f), f.only(freezes(f), "collected_as_sysadmin")]


def tempdb_profile(f: Facts) -> list[DataFrame]:
    return [memory_optimized_tempdb(f), trace_flags(f, (715, 716), True), tempdb_layout(f, True), tempdb_files(f), tempdb_stalls(f),
            resource_limits(f), accelerated_recovery(f)]


