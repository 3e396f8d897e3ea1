"""Reports for review: backups, restores, groups, tempdb. Each returns one sorted DataFrame."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fold, minutes_between, parent_location, scaled, seconds_between, statement_slice
from ..operators import (backup_detail as detail_of, chain_report, contention as contention_of, last_by_type_wide,
                         latest_per_key, scope, session_space, space_summary as summary_of, transaction_log_use)
from ..operators.scope import TEMPDB_ID
from ..operators.space import PAGES_PER, unit_of
from . import discovery
from .facts import BACKUP_TYPES, Facts, text_for

# Codes of the backup and restore history: fixed values.
RECOVERY_MODELS = {"S": "Simple", "B": "Bulk Logged", "F": "Full"}
RESTORE_TYPES = {"D": "Database", "F": "File", "G": "Filegroup", "I": "Differential", "L": "Log", "V": "Verify Only"}


def _yes_no(flag: str, unknown: str | None = "No", yes: str = "Yes", no: str = "No") -> Column:
    return F.when(F.col(flag), yes).when(~F.col(flag), no).otherwise(F.lit(unknown))


def backup_summary(f: Facts) -> DataFrame:
    """One row per eligible database: minutes since the last backup, and the last one of each type."""
    keys = ["instance_id", "db_key"]
    # The last set of each type from whole numbers and times alone; only its files are then looked at.
    per_type = f.history.groupBy(*keys, "type").agg(
        F.max(F.when(F.col("family_sequence_number") == 1, F.col("backup_set_id"))).alias("backup_set_id"), F.max("backup_start_date").alias("latest"))
    last_sets = per_type.where(F.col("type").isin(*BACKUP_TYPES) & F.col("backup_set_id").isNotNull()).select(*keys, "backup_set_id")
    per_set = f.history.join(last_sets, [*keys, "backup_set_id"], "left_semi").groupBy(*keys, "backup_set_id").agg(
        F.count(F.lit(1)).alias("number_of_files"),
        F.max(F.when(F.col("family_sequence_number") == 1, F.struct(
            "type", "is_copy_only", F.col("backup_start_date").alias("start"), F.col("backup_finish_date").alias("finish"),
            F.col("backup_size").alias("size"), "physical_device_name", "device_text"))).alias("s"))
    sets = per_set.select(
        *keys, "backup_set_id", "number_of_files", F.col("s.type").alias("type"),
        _yes_no("s.is_copy_only").alias("copy_only"), F.col("s.start").alias("start"), F.col("s.finish").alias("finish"),
        seconds_between("s.start", "s.finish").alias("duration_seconds"),
        F.expr("coalesce(try_cast(s.size AS BIGINT) div 1048576, s.size div 1048576)").alias("size_mb"), parent_location("s.physical_device_name", "s.device_text").alias("path"),
        F.col("s.device_text").alias("device_type"))
    payload = ["copy_only", "start", "finish", "duration_seconds", "size_mb", "path", "number_of_files", "device_type"]
    wide = last_by_type_wide(sets, keys, "type", {"D": "full", "I": "diff", "L": "log"}, "backup_set_id", payload)
    latest = per_type.groupBy(*keys).agg(F.max("latest").alias("latest"))
    out = (f.eligible.select("instance_id", F.col("name").alias("database_name"), fold("name").alias("db_key"), "group_name",
                             "is_preferred_backup_replica", "recovery_model_desc")
           .join(latest, keys, "left").join(wide, keys, "left")
           .withColumn("preferred_backup_replica", _yes_no("is_preferred_backup_replica", None))
           .withColumn("minutes_since_last_backup", minutes_between("latest", f.params.now)))
    return out.select("instance_id", "database_name", "group_name", "preferred_backup_replica", "recovery_model_desc",
                      "minutes_since_last_backup", "last_full_copy_only",
                      *[f"last_{k}_{c}" for k in ("full", "diff", "log") for c in payload[1:]]).orderBy(
        "instance_id", "database_name", "recovery_model_desc")


def backup_detail(f: Facts) -> DataFrame:
    """Each backup file with its share of the size and the compression, newest first."""
    p = f.params
    code = {v: k for k, v in BACKUP_TYPES.items()}
    # The file count is that of the whole set, so the type filter comes after it.
    rows = scope(detail_of(f.history, ["instance_id", "backup_set_id"], "backup_size", "compressed_backup_size"),
                 remap={"type": code}, type=p.backup_type)
    group = f.eligible.select("instance_id", "database_id", "group_name")
    return rows.join(group, ["instance_id", "database_id"]).select(
        "instance_id", "database_name", "group_name", text_for(F.substring("recovery_model", 1, 1), RECOVERY_MODELS).alias("recovery_model"),
        text_for(F.col("type"), BACKUP_TYPES).alias("backup_type"), "backup_set_id", _yes_no("is_copy_only").alias("copy_only"),
        _yes_no("is_snapshot").alias("snapshot"), _yes_no("is_password_protected").alias("password_protected"),
        _yes_no("has_backup_checksums").alias("has_checksum"), F.coalesce("encryptor_type", F.lit("None")).alias("encryption"),
        "backup_start_date", "backup_finish_date", seconds_between("backup_start_date", "backup_finish_date").alias("duration_seconds"),
        "size_mb", "compressed_size_mb", "compression_percent", "physical_device_name", "logical_device_name",
        F.col("device_text").alias("device_type"), "user_name", "family_sequence_number").orderBy(F.desc("backup_start_date"))


def backup_chain(f: Facts) -> DataFrame:
    """Distinct locations of each database and backup type, with their number."""
    own = f.backup_locations.where(~F.col("is_copy_only"))
    chain = scope(chain_report(own, ["instance_id", "database_id", "database_name", "type"], "location"),
                  remap={"type": {v: k for k, v in BACKUP_TYPES.items()}}, type=f.params.backup_type)
    group = f.eligible.select("instance_id", "database_id", "group_name")
    return (chain.join(group, ["instance_id", "database_id"])
            .select("instance_id", "database_name", "group_name", text_for(F.col("type"), BACKUP_TYPES).alias("backup_type"),
                    "number_of_paths", F.col("location").alias("backup_path"))
            .orderBy("instance_id", "database_name", "group_name", "backup_type", "backup_path"))


def _restores(f: Facts, start=None, end=None) -> DataFrame:
    return f.fleet.between("restore_history", start, end).drop("snapshot_ts").withColumn("db_key", fold("destination_database_name"))


def last_restore(f: Facts) -> DataFrame:
    """The last restore of every database, or none."""
    last = latest_per_key(_restores(f), ["instance_id", "db_key"], ["restore_date", "user_name"], ["restore_date", "user_name"])
    return (f.databases.select("instance_id", F.col("name").alias("database_name"), "db_key").join(last, ["instance_id", "db_key"], "left")
            .drop("db_key").orderBy("instance_id", "database_name"))


def restore_history(f: Facts) -> DataFrame:
    """Restores, newest first; a date range applies only when set."""
    p = f.params
    rows = _restores(f, p.start, p.end)
    names = f.databases.select("instance_id", "db_key", F.col("name").alias("database_name"))
    return rows.join(names, ["instance_id", "db_key"]).select(
        "instance_id", "database_name", "restore_date", "user_name", text_for(F.col("restore_type"), RESTORE_TYPES, "Unknown").alias("restore_type"),
        _yes_no("replace", "Unknown").alias("replace"), _yes_no("recovery", "Unknown", "Recovery", "No Recovery").alias("recovery"),
        F.col("stop_at").alias("stop_at_time")).orderBy(F.desc("restore_date"))


def group_instances(f: Facts) -> DataFrame:
    """One row of facts per instance that takes part in a group."""
    return f.in_groups(discovery.wide(f, discovery.AG_WIDE)).orderBy("instance_id")


def health_instances(f: Facts) -> DataFrame:
    """One row of facts per instance, trace flags in one cell."""
    return discovery.wide(f, discovery.HEALTH_WIDE).orderBy("instance_id")


def cluster(f: Facts) -> DataFrame:
    return f.in_groups(f.fleet["instances"]).select(
        "instance_id", "cluster_name", F.translate("quorum_type", "_", " ").alias("quorum_type"),
        F.translate("quorum_state", "_", " ").alias("quorum_state")).orderBy("instance_id")


def cluster_members(f: Facts) -> DataFrame:
    return f.cluster_members.select("instance_id", "member_name", "member_type", "member_state", "number_of_quorum_votes").orderBy(
        "instance_id", "member_type", "member_name")


def endpoints(f: Facts) -> DataFrame:
    return f.endpoints.select("instance_id", F.col("name").alias("endpoint_name"), "owner_name", "owner_sid",
                              _yes_no("owner_is_sysadmin").alias("owner_is_sysadmin"), "endpoint_state",
                              F.col("connection_auth_desc").alias("authentication"), "certificate", "certificate_expiry").orderBy(
        "instance_id", "endpoint_name")


def groups(f: Facts) -> DataFrame:
    return f.groups.drop("group_id").orderBy("instance_id", "group_name")


def listeners(f: Facts) -> DataFrame:
    return f.listeners.select("instance_id", "dns_name", "port", "ip_address",
                              F.concat("subnet_ip", F.lit("/"), F.col("subnet_prefix").cast("string")).alias("subnet"), "ip_state", "group_name").orderBy(
        "instance_id", "group_name", "dns_name", "ip_address")


def replicas(f: Facts) -> DataFrame:
    return f.replicas.select("instance_id", "group_name", "server_instance", F.col("role_desc").alias("current_role"), "availability_mode",
                             F.col("failover_mode_desc").alias("failover_mode"), "primary_allow_desc", "secondary_allow_desc",
                             F.col("seeding").alias("seeding_mode"), "session_timeout", "endpoint_url",
                             F.col("connected_state_desc").alias("connected_state")).orderBy("instance_id", "group_name", "server_instance")


def replica_databases(f: Facts) -> DataFrame:
    owners = f.logins.select("instance_id", F.col("sid").alias("owner_sid"), F.col("name").alias("owner"))
    owned = (f.fleet["databases"].select("instance_id", "database_id", "owner_sid").join(owners, ["instance_id", "owner_sid"])
             .select("instance_id", "database_id", "owner", F.lit(True).alias("is_local")))
    return (f.replica_databases.join(owned, ["instance_id", "database_id", "is_local"], "left")
            .select("instance_id", "database_name", "database_state", "group_name", "server_instance", "current_role", "synchronization_state",
                    F.col("local_text").alias("is_local"), F.col("joined").alias("is_joined"), F.col("suspended").alias("is_suspended"),
                    F.col("failover_ready").alias("is_failover_ready"), F.coalesce("owner", F.lit("[UNKNOWN]")).alias("database_owner"),
                    F.col("lag_seconds").alias("secondary_lag_seconds"))
            .orderBy("instance_id", "group_name", "database_name", "server_instance"))


def state_change_history(f: Facts) -> DataFrame:
    return f.state_changes.orderBy(F.desc("event_time"))


def tempdb_file_properties(f: Facts) -> DataFrame:
    """Sizes in MB, growth and limit as text."""
    growth, limit = F.col("growth"), F.col("max_size")
    mb = PAGES_PER["MB"]

    def in_mb(c: str) -> Column:
        return F.expr(f"{c} div {mb}")

    step = F.when(growth == 0, "None").when(F.col("is_percent_growth"), F.concat_ws(" ", growth, F.lit("percent"))).when(
        ~F.col("is_percent_growth"), F.concat_ws(" ", in_mb("growth"), F.lit("MB")))
    top = F.when(growth == 0, "N/A").when(limit == 0, "No growth allowed").when(limit == -1, "Unlimited growth").otherwise(
        F.concat_ws(" ", in_mb("max_size"), F.lit("MB")))
    return f.tempdb_files.select("instance_id", "file_id", F.col("name").alias("logical_name"), F.col("type_desc").alias("file_type"),
                                 F.coalesce("filegroup", F.lit("Not Applicable")).alias("filegroup"), in_mb("initial_size").alias("initial_size_mb"),
                                 in_mb("size").alias("current_size_mb"), step.alias("autogrowth"), top.alias("max_size"), "physical_name").orderBy(
        "instance_id", "file_id")


def tempdb_space(f: Facts) -> DataFrame:
    """Space of tempdb per instance in MB or GB."""
    unit = unit_of(f.params.unit)
    pages = summary_of(f.fleet["file_space"], ["instance_id"], {
        "total_space": "total_pages", "used_space": "allocated_pages", "free_space": "unallocated_pages", "user_object_space": "user_pages",
        "internal_object_space": "internal_pages", "version_store_space": "version_store_pages"}, unit)
    logs = summary_of(f.tempdb_files.where("type = 1"), ["instance_id"], {"log_file_size": "size"}, unit)
    used = f.fleet["instances"].select("instance_id", scaled("log_space_used_bytes", PAGES_PER[unit] * 8192).alias("log_space_used"))
    return pages.join(logs, "instance_id", "left").join(used, "instance_id", "left").orderBy("instance_id")


def tempdb_sessions(f: Facts) -> DataFrame:
    """Space by session, largest first."""
    keys = ["instance_id", "session_id"]
    use = session_space(f.fleet["session_space"], f.fleet["task_space"], keys, "user_alloc", "user_dealloc", "internal_alloc",
                        "internal_dealloc", f.params.unit)
    people = f.fleet["sessions"].select(*keys, "login_name", F.col("batch_text").alias("statement_text"))
    return use.join(people, keys).orderBy(F.desc_nulls_last("session_space"), F.desc_nulls_last("running_space"))


def tempdb_log_use(f: Facts) -> DataFrame:
    """Transactions that wrote to the log of tempdb, largest first."""
    keys = ["instance_id", "session_id"]
    people = f.fleet["sessions"].select(*keys, "login_name", "batch_text")
    running = f.fleet["requests"].select(*keys, "statement_start", "statement_end")
    rows = (f.fleet["transactions"].drop("snapshot_ts").where(F.col("database_id") == TEMPDB_ID).join(people, keys).join(running, keys, "left"))
    return transaction_log_use(rows, f.params.unit).select(
        *keys, "login_name", F.col("begin_time").alias("start_time"), F.col("log_record_count").alias("log_records"), "log_used", "log_reserved",
        F.col("batch_text").alias("outer_statement"), "statement_text").orderBy(F.desc_nulls_last("log_used"))


def tempdb_contention(f: Facts) -> DataFrame:
    """Latch waits on tempdb pages, from version 15 on or on managed instances."""
    waits = contention_of(f.fleet["requests"].drop("snapshot_ts"), f.fleet["page_info"].drop("snapshot_ts"))
    return f.only(waits, "major >= 15 OR is_managed").select(
        "instance_id", "session_id", "wait_type", "wait_resource", "object_name", "blocking_session_id", "command",
        statement_slice("batch_text", "statement_start", "statement_end").alias("statement_text"), "database_id", "file_id", "page_id",
        "object_id", "index_id", "page_type_desc", F.col("contention_kind").alias("allocation_type"))


REPORTS = {fn.__name__: fn for fn in (
    backup_summary, backup_detail, backup_chain, last_restore, restore_history, group_instances, cluster, cluster_members, endpoints, groups,
    listeners, replicas, replica_databases, state_change_history, health_instances, tempdb_file_properties, tempdb_space, tempdb_sessions,
    tempdb_log_use, tempdb_contention)}
