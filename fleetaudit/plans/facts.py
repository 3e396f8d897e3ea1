"""Facts that several checks and reports share, each a lazy DataFrame built once per run."""
from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import as_ts, fold, parent_location, percent_of
from ..functions.stage import staged
from ..operators import LogPattern, eligible_databases, log_extract, pairing_summary, scope, state_changes, version_columns
from ..operators.scope import LAST_SYSTEM_ID, MANAGED_EDITION, NOT_AVAILABLE_STATES, TEMPDB_ID
from ..params import AuditParams
from ..schemas import SA_SID
from ..sources import Fleet

# Codes and their texts: fixed values.
DEVICE_TYPES = {2: "Disk", 5: "Tape", 7: "Virtual Device", 9: "Azure Storage", 105: "A permanent Backup Device"}
BACKUP_TYPES = {"D": "Full", "I": "Differential", "L": "Transaction Log"}


def text_for(code: Column, texts: dict, default: str | None = None) -> Column:
    """Short code to text in place."""
    out = reduce(lambda acc, kv: acc.when(code == kv[0], kv[1]), texts.items(), F)
    return out if default is None else out.otherwise(default)


def raw(df: DataFrame, check_id: int, database=None, object=None, metric=None, case_no=0) -> DataFrame:
    """Rows of ``df`` as raw findings of one check."""
    def typed(c, kind: str) -> Column:
        c = F.col(c) if isinstance(c, str) else F.lit(c)
        return c.cast(kind)

    return df.select("instance_id", F.lit(check_id).alias("check_id"), typed(F.lit(case_no), "int").alias("case_no"),
                     typed(database, "string").alias("database_name"), typed(object, "string").alias("object_name"),
                     typed(metric, "double").alias("metric"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Facts:
    def __init__(self, fleet: Fleet, params: AuditParams):
        self.fleet, self.params = fleet, params

    def _shared(self, df: DataFrame, name: str) -> DataFrame:
        """A fact that several checks start from: written once when the run asks for it."""
        return staged(df, name) if self.params.stage_facts else df

    # Instances -----------------------------------------------------------------------------

    @cached_property
    def instances(self) -> DataFrame:
        """One row per instance with major version, build and the managed flag."""
        return (version_columns(self.fleet["instances"])
                .withColumn("is_managed", F.coalesce(F.col("engine_edition") == MANAGED_EDITION, F.lit(False))))

    @cached_property
    def gate(self) -> DataFrame:
        """The few instance columns that rules test, for narrow joins."""
        return self.instances.select("instance_id", "major", "engine_edition", "is_managed", "collected_as_sysadmin")

    def only(self, df: DataFrame, condition: str) -> DataFrame:
        """Rows of the instances that meet a condition on the gate columns."""
        return df.join(self.gate.where(condition).select("instance_id"), "instance_id", "left_semi")

    @cached_property
    def drives(self) -> DataFrame:
        """First volume of each drive with its used percentage."""
        first = self.fleet["drives"].groupBy("instance_id", "drive").agg(
            F.min(F.struct(F.coalesce("volume", F.lit("")), "total_mb", "free_mb")).alias("v"))
        return (first.select("instance_id", "drive", "v.total_mb", "v.free_mb")
                .withColumn("used_percent", percent_of(F.col("total_mb") - F.col("free_mb"), "total_mb")))

    @cached_property
    def other_drives(self) -> DataFrame:
        """Number of drives other than C per instance."""
        return self.fleet["drives"].where("drive <> 'C'").groupBy("instance_id").agg(
            F.countDistinct("drive").alias("other_drives"))

    # Databases -----------------------------------------------------------------------------

    @cached_property
    def databases(self) -> DataFrame:
        return scope(self.fleet["databases"], name=self.params.database_name).withColumn("db_key", fold("name"))

    @cached_property
    def online_user(self) -> Column:
        """Test for the list most database checks run over: online, not a system database."""
        return (F.col("state") == 0) & (F.col("database_id") > LAST_SYSTEM_ID)

    @cached_property
    def readable_databases(self) -> DataFrame:
        """Online databases that are no snapshots and no unreadable secondaries."""
        closed = (self.fleet["ag_databases"].where(F.col("is_local") & ~F.col("is_primary_replica"))
                  .join(self.fleet["ag_replicas"].where("secondary_allow_desc = 'NO'"), ["instance_id", "replica_id"], "left_semi")
                  .select("instance_id", fold("database_name").alias("db_key")))
        listed = self.databases.where((F.col("state") == 0) & F.col("source_database_id").isNull())
        return self._shared(listed.select("instance_id", "db_key", "database_id", "name").join(closed, ["instance_id", "db_key"], "left_anti"),
                            "readable")

    @cached_property
    def eligible(self) -> DataFrame:
        return eligible_databases(self.databases.drop("db_key"), self.fleet["ag_membership"], self.instances)

    @cached_property
    def backup_coverage(self) -> DataFrame:
        """Eligible databases with their last full, log and any backup (null: never).

        One aggregate over the backup sets serves five checks.
        """
        sets = (scope(self.fleet["backup_sets"], database_name=self.params.database_name)
                .where(F.col("backup_finish_date").isNotNull()))

        def last(kind: str) -> Column:
            return F.max(F.when(F.col("type") == kind, F.col("backup_start_date")))

        # The history shrinks to a few rows per database before it meets the instances.
        per_server = sets.groupBy("instance_id", fold("database_name").alias("db_key"), fold("server_name").alias("server_key")).agg(
            last("D").alias("full"), last("L").alias("log"), F.max("backup_start_date").alias("any"))
        own = self.instances.select("instance_id", fold("server_name_prop").alias("own_key"))
        per_db = (per_server.join(own, "instance_id").where(F.coalesce("server_key", "own_key") == F.col("own_key"))
                  .groupBy("instance_id", "db_key").agg(F.max("full").alias("last_full"), F.max("log").alias("last_log"),
                                                        F.max("any").alias("last_any")))
        return self.eligible.join(per_db, ["instance_id", "db_key"], "left")

    @cached_property
    def history(self) -> DataFrame:
        """Backup files of the date range, on databases that exist and are available."""
        p = self.params
        # The server's name joins to the databases, not to the many sets.
        there = (self.databases.where((F.col("database_id") != TEMPDB_ID) & ~F.col("state").isin(*NOT_AVAILABLE_STATES)
                                      & ~F.col("is_in_standby") & F.col("source_database_id").isNull())
                 .join(self.instances.select("instance_id", fold("server_name_prop").alias("server_key")), "instance_id")
                 .select("instance_id", "db_key", "server_key", "database_id", F.col("name").alias("current_name")))
        sets = (scope(self.fleet.between("backup_sets", p.range_start, p.range_end), database_name=p.database_name, is_copy_only=p.show_copy_only)
                .withColumn("db_key", fold("database_name")).withColumn("server_key", fold("server_name")).drop("snapshot_ts"))
        media = self.fleet.between("backup_media", p.range_start, p.range_end).drop("snapshot_ts").withColumn(
            "device_text", text_for(F.col("device_type"), DEVICE_TYPES, "UNKNOWN"))
        rows = (sets.join(there, ["instance_id", "db_key", "server_key"])
                .join(scope(media, device_text=p.device_type), ["instance_id", "media_set_id"])
                .where("of_set_id IS NULL OR of_set_id = backup_set_id").drop("of_set_id"))
        return self._shared(rows, "history")

    @cached_property
    def backup_locations(self) -> DataFrame:
        """History with ``location``: the folder of the set's first file, else the file's device type."""
        first = (self.history.where("family_sequence_number = 1")
                 .select("instance_id", "backup_set_id", parent_location("physical_device_name", "device_text").alias("folder")))
        return (self.history.join(first, ["instance_id", "backup_set_id"])
                .withColumn("location", F.coalesce("folder", "device_text")))

    # Logins --------------------------------------------------------------------------------

    @cached_property
    def sysadmins(self) -> DataFrame:
        """Folded names that hold the sysadmin role, one row each."""
        return (self.fleet["server_role_members"].where(fold("role_name") == "sysadmin")
                .select("instance_id", fold("member_name").alias("login_key")).distinct())

    @cached_property
    def logins(self) -> DataFrame:
        """Principals with ``is_sysadmin``."""
        flag = self.sysadmins.withColumn("_sys", F.lit(True))
        return self._shared(self.fleet["server_principals"].drop("snapshot_ts").withColumn("login_key", fold("name"))
                            .join(flag, ["instance_id", "login_key"], "left")
                            .withColumn("is_sysadmin", F.coalesce("_sys", F.lit(False))).drop("_sys"), "logins")

    @cached_property
    def services(self) -> DataFrame:
        """Engine and Agent services with ``kind`` and ``account_key``."""
        name = fold("servicename")
        return (self.fleet["server_services"].drop("snapshot_ts")
                .withColumn("kind", F.when(name.startswith("sql server agent"), "agent").when(name.startswith("sql server"), "engine"))
                .withColumn("account_key", fold("service_account")))

    # Availability groups -------------------------------------------------------------------

    def _group_scope(self, df: DataFrame) -> DataFrame:
        return scope(df, group_name=self.params.group_name)

    @cached_property
    def group_instances(self) -> DataFrame:
        """Instances that take part in an availability group."""
        return self._shared(self.fleet["ag_groups"].select("instance_id").distinct(), "group-instances")

    def in_groups(self, df: DataFrame) -> DataFrame:
        return df.join(self.group_instances, "instance_id", "left_semi")

    @cached_property
    def groups(self) -> DataFrame:
        """One row per instance and group; flags count from the version that introduced them."""
        routed = (self.fleet["ag_replicas"].groupBy("instance_id", "group_id")
                  .agg(F.bool_or(F.col("read_only_routing_url").isNotNull()).alias("routed")))
        owners = self.logins.select("instance_id", F.col("sid").alias("owner_sid"), F.col("name").alias("owner_name"))

        def yes(flag: str, since: int) -> Column:
            return F.when((F.col("major") >= since) & F.col(flag), "Yes").otherwise("No")

        rows = (self._group_scope(self.fleet["ag_groups"].drop("snapshot_ts"))
                .join(self.gate.select("instance_id", "major"), "instance_id")
                .join(owners, ["instance_id", "owner_sid"])
                .join(routed, ["instance_id", "group_id"])
                .select("instance_id", "group_id", "group_name", F.col("role_desc").alias("current_role"), "owner_name", "owner_sid",
                        F.upper("backup_preference_desc").alias("backup_preference"),
                        F.when((F.col("major") >= 14) & (F.col("cluster_type") == 2), "External").otherwise("WSFC").alias("cluster_type"),
                        yes("is_contained", 15).alias("is_contained"), yes("db_failover", 13).alias("database_level_health_detection"),
                        yes("dtc_support", 13).alias("dtc_support"),
                        F.when(F.col("routed"), "Yes").otherwise("No").alias("read_only_routing_enabled"), "health_check_timeout"))
        return self._shared(rows, "groups")

    @cached_property
    def replicas(self) -> DataFrame:
        df = scope(self._group_scope(self.fleet["ag_replicas"].drop("snapshot_ts")), is_local=self.params.local_only)
        rows = (df.join(self.gate.select("instance_id", "major"), "instance_id")
                .withColumn("availability_mode", F.translate("availability_mode_desc", "_", " "))
                .withColumn("seeding", F.when((F.col("major") >= 13) & (F.col("seeding_mode") == 0), "AUTOMATIC").otherwise("MANUAL")))
        return self._shared(rows, "replicas")

    @cached_property
    def replica_databases(self) -> DataFrame:
        """Databases of replicas; unknown states get their default texts, lag counts from version 13 on."""
        def yes(flag: str) -> Column:
            return F.when(F.col(flag), "Yes").otherwise("No")

        df = scope(self._group_scope(self.fleet["ag_databases"].drop("snapshot_ts")), is_local=self.params.local_only)
        return (df.join(self.gate.select("instance_id", "major"), "instance_id")
                .withColumn("database_state", F.coalesce("database_state_desc", F.lit("[UNKNOWN]")))
                .withColumn("synchronization_state", F.coalesce("synchronization_state_desc", F.lit("NOT SYNCHRONIZING")))
                .withColumn("current_role", F.when(F.col("is_primary_replica"), "PRIMARY").otherwise("SECONDARY"))
                .withColumn("local_text", yes("is_local")).withColumn("joined", yes("is_database_joined"))
                .withColumn("suspended", yes("is_suspended")).withColumn("failover_ready", yes("is_failover_ready"))
                .withColumn("lag_seconds", F.when(F.col("major") >= 13, F.col("secondary_lag_seconds"))))

    @cached_property
    def listeners(self) -> DataFrame:
        return self._group_scope(self.fleet["ag_listeners"].drop("snapshot_ts"))

    @cached_property
    def cluster_members(self) -> DataFrame:
        return (self.fleet["cluster_members"].drop("snapshot_ts")
                .withColumn("member_type", F.translate("member_type_desc", "_", " "))
                .withColumn("member_state", F.translate("member_state_desc", "_", " ")))

    @cached_property
    def endpoints(self) -> DataFrame:
        """Mirroring endpoints with their owner and certificate."""
        owner = self.logins.select("instance_id", "principal_id", F.col("name").alias("owner_name"),
                                   F.col("sid").alias("owner_sid"), F.col("is_sysadmin").alias("owner_is_sysadmin"))
        return (self.fleet["endpoints"].drop("snapshot_ts").where("type = 4")
                .join(owner, ["instance_id", "principal_id"])
                .withColumn("endpoint_state", F.translate("state_desc", "_", " "))
                .withColumn("certificate", F.coalesce("certificate_name", F.lit("(Windows Authentication)"))))

    @cached_property
    def state_changes(self) -> DataFrame:
        """Replica state changes of instances whose health session is present."""
        on = self.fleet["xe_sessions"].where(fold("name") == "alwayson_health").select("instance_id").distinct()
        listed = self.fleet["instances"].join(on, "instance_id", "left_semi")
        return self._group_scope(state_changes(self.fleet["xe_events"], listed))

    # Files, tempdb, log --------------------------------------------------------------------

    @cached_property
    def files(self) -> DataFrame:
        """Files with the drive letter and the name of their database."""
        names = self.fleet["databases"].select("instance_id", "database_id", F.col("name").alias("database_name"),
                                               F.col("state").alias("database_state"))
        return (self.fleet["files"].drop("snapshot_ts")
                .join(names, ["instance_id", "database_id"], "left")
                .withColumn("drive", F.upper(F.substring("physical_name", 1, 1)))
                .withColumn("on_c", fold("physical_name").startswith("c:\\")))

    @cached_property
    def tempdb_files(self) -> DataFrame:
        return self.fleet["files"].drop("snapshot_ts").where(F.col("database_id") == TEMPDB_ID)

    @cached_property
    def tempdb_stalls(self) -> DataFrame:
        """Average stall per read and per write of tempdb files, fraction dropped."""
        def average(total: str, count: str) -> Column:
            return F.expr(f"{total} div nullif({count}, 0)")

        io = self.fleet["io_stats"].drop("snapshot_ts").where(
            (F.col("database_id") == TEMPDB_ID) & ((F.col("num_of_reads") > 0) | (F.col("num_of_writes") > 0)))
        return (io.join(self.tempdb_files.select("instance_id", "database_id", "file_id", "name"), ["instance_id", "database_id", "file_id"])
                .withColumn("read_stall_ms", average("io_stall_read_ms", "num_of_reads"))
                .withColumn("write_stall_ms", average("io_stall_write_ms", "num_of_writes")))

    @cached_property
    def freezes(self) -> DataFrame:
        """Number and average duration of freezes per database: each freeze line with the next resume line."""
        # The name ends at a period before a space or the end, as names may hold periods.
        tail = r" database\s+(.*?)\s*\.(?:\s.*)?$"
        events = log_extract(self.fleet["error_log"], [
            LogPattern("frozen", "I/O is frozen on database", r"^I/O is frozen on" + tail, ("database_name",)),
            LogPattern("resumed", "I/O was resumed on database", r"^I/O was resumed on" + tail, ("database_name",))])
        return pairing_summary(events.withColumn("db_key", fold("database_name")), ["instance_id", "db_key"], "log_date",
                               F.col("kind") == "frozen", F.col("kind") == "resumed", bucket="1 hour")

    @cached_property
    def sa(self) -> Column:
        return F.lit(SA_SID)

    @cached_property
    def log_facts(self) -> DataFrame:
        """What single lines of the error log say about an instance: the earliest line of three kinds, the
        number of failed logins, and whether files are initialized instantly."""
        text, log = fold("message"), self.fleet["error_log"]
        said = {"log_file_line": "logging sql server messages in file", "version_line": "copyright", "maker_line": "system manufacturer:"}

        def first(words: str) -> Column:
            line = F.when(text.contains(words), F.col("message"))
            return F.min_by(line, F.when(line.isNotNull(), F.struct("log_date", "message")))

        # Every line feeds two fixed-width cells of a hash aggregate; an instance with no line at all has no row.
        per = log.groupBy("instance_id").agg(
            F.count_if(text.contains("login failed")).alias("failed_logins"),
            F.bool_or(text.startswith("database instant file initialization: enabled")).alias("instant_init"))
        # The texts are taken from the few lines that a start of the server writes.
        any_of = reduce(Column.__or__, [text.contains(words) for words in said.values()])
        lines = log.where(any_of).groupBy("instance_id").agg(*[first(words).alias(name) for name, words in said.items()])
        per = per.join(lines, "instance_id", "left")
        return self._shared(per, "log-facts")

    def within(self, expiry: str) -> Column:
        """Expiry limit when one is set, else always true."""
        days = self.params.certificate_within_days
        return F.lit(True) if days is None else F.col(expiry) <= as_ts(self.params.as_of) + F.expr(f"INTERVAL {days} DAYS")
