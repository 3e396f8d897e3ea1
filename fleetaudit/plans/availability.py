"""Availability checks (4xx)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fold
from ..operators import (RowRule, group_heterogeneity, missing_coverage, ratio_threshold, recent_change,
                         required_set_missing, rule_scan)
from .facts import Facts, raw, union


def database_states(f: Facts) -> DataFrame:
    """401-405 in one scan."""
    db, access = F.col("name"), F.col("user_access_desc")
    return rule_scan(f.databases, [
        RowRule(401, access == "SINGLE_USER", db), RowRule(402, access == "RESTRICTED_USER", db),
        RowRule(403, F.col("is_read_only") & F.col("source_database_id").isNull(), db),
        RowRule(404, F.col("state") == 6, db), RowRule(405, F.col("state") == 4, db)])


def endpoints(f: Facts) -> DataFrame:
    """406, 411, 420: owner, state and certificate of mirroring endpoints."""
    rows = f.endpoints.join(f.gate.select("instance_id", "collected_as_sysadmin"), "instance_id")
    name, expiry = F.col("name"), F.date_format("certificate_expiry", "yyyy-MM-dd")
    return rule_scan(rows, [
        RowRule(406, F.col("owner_sid") != f.sa, object=F.concat_ws(" ", name, "owner_name")),
        RowRule(411, F.col("endpoint_state") != "STARTED", object=name),
        RowRule(420, F.col("collected_as_sysadmin") & F.col("certificate_expiry").isNotNull() & f.within("certificate_expiry"),
                object=F.concat_ws(" ", name, "certificate", expiry))])


def groups(f: Facts) -> DataFrame:
    """407, 416, 424: owner, backup preference and health check timeout of groups."""
    name, timeout = F.col("group_name"), F.col("health_check_timeout")
    return rule_scan(f.groups, [
        RowRule(407, F.col("owner_sid") != f.sa, object=F.concat_ws(" ", name, "owner_name")),
        RowRule(416, F.col("backup_preference") != "PRIMARY", object=F.concat_ws(" ", name, "backup_preference")),
        RowRule(424, timeout == 30000, object=name, metric=timeout),
        RowRule(424, timeout < 30000, object=name, metric=timeout, case_no=1)])


def replicas(f: Facts) -> DataFrame:
    """415, 418, 431: timeout, seeding and connection of replicas."""
    timeout, what = F.col("session_timeout"), F.concat_ws(" ", "group_name", "server_instance")
    return rule_scan(f.replicas, [
        RowRule(415, timeout == 10, object=what, metric=timeout), RowRule(415, timeout < 10, object=what, metric=timeout, case_no=1),
        RowRule(418, F.col("seeding") == "AUTOMATIC", object=what),
        RowRule(431, F.col("connected_state_desc") == "DISCONNECTED", object=what)])


def replica_databases(f: Facts) -> DataFrame:
    """413, 414, 421, 423, 430: databases of replicas, joined once to their replica."""
    replica = f.replicas.select("instance_id", "replica_id", F.col("server_instance").alias("replica_name"), "availability_mode",
                                "failover_mode_desc", F.col("group_id").alias("replica_group"))
    rows = f.replica_databases.join(replica, ["instance_id", "replica_id"], "left")
    db, group, lag = F.col("database_name"), F.col("group_name"), F.col("lag_seconds")
    on = F.concat_ws(" ", group, "replica_name")
    same = F.col("group_id") == F.col("replica_group")
    return rule_scan(rows, [
        RowRule(413, F.col("joined") == "No", db, group), RowRule(414, F.col("suspended") == "Yes", db, group),
        RowRule(421, (F.col("failover_ready") != "Yes") & (F.col("failover_mode_desc") == "AUTOMATIC"), db, on),
        RowRule(423, same & (lag > 5), db, on, lag),
        RowRule(430, same & (F.col("availability_mode") == "SYNCHRONOUS COMMIT") & (F.col("synchronization_state") != "SYNCHRONIZED"),
                db, F.concat_ws(" ", on, "synchronization_state"))])


def quorum(f: Facts) -> DataFrame:
    """408-410: members up, votes, members down."""
    up = (F.col("member_state") == "UP") & (F.col("number_of_quorum_votes") > 0)
    per = f.cluster_members.groupBy("instance_id").agg(F.count_if(up).alias("up"), F.sum("number_of_quorum_votes").alias("votes"))
    per = per.join(f.fleet["instances"].select("instance_id", "cluster_name"), "instance_id")
    down = f.cluster_members.where("member_state <> 'UP'")
    cluster = F.col("cluster_name")
    return union(rule_scan(per, [RowRule(408, F.col("up") < 3, object=cluster, metric=F.col("up")),
                                 RowRule(409, F.col("votes") < 3, object=cluster, metric=F.col("votes"))]),
                 raw(down, 410, None, "member_name"))


def mixed_modes(f: Facts) -> DataFrame:
    """412, 427, 428: seeding or failover modes that differ inside a group or on one host."""
    keys = ["instance_id", "group_name"]
    named = f.groups.select(*keys).distinct()

    def mixed(value: str, check_id: int) -> DataFrame:
        return raw(named.join(group_heterogeneity(f.replicas, keys, value), keys, "left_semi"), check_id, None, "group_name")

    # Members are hosts, replicas are host\instance: compare the host part.
    hosted = f.replicas.withColumn("member_key", fold(F.split_part("server_instance", F.lit("\\"), F.lit(1))))
    per_host = group_heterogeneity(hosted, ["instance_id", "member_key"], "failover_mode_desc")
    members = f.cluster_members.withColumn("member_key", fold("member_name")).join(per_host, ["instance_id", "member_key"], "left_semi")
    return union(mixed("seeding", 412), mixed("failover_mode_desc", 427), raw(members, 428, None, "member_name"))


def listeners(f: Facts) -> DataFrame:
    """417: listeners none of whose addresses is online."""
    online = f.listeners.where("ip_state = 'ONLINE'")
    down = missing_coverage(f.listeners, online, ["instance_id", "dns_name"])
    return raw(down, 417, None, F.concat_ws(" ", "dns_name", "ip_address", "ip_state"))


def trace_flags(f: Facts) -> DataFrame:
    """419, 425: flags that change group behaviour."""
    flag = F.col("trace_flag")
    return rule_scan(f.in_groups(f.fleet["trace_flags"]), [RowRule(419, flag == "9567", object=flag), RowRule(425, flag == "1800", object=flag)])


def commit_waits(f: Facts) -> DataFrame:
    """422: more than 5 ms a synchronous commit."""
    waits = f.in_groups(f.fleet["wait_stats"].where("wait_type = 'HADR_SYNC_COMMIT'"))
    slow = ratio_threshold(waits, F.col("wait_time_ms").cast("double"), F.col("waiting_tasks_count").cast("double") + 1, 5.0)
    return raw(slow, 422, None, "wait_type", "ratio")


def recent_state_changes(f: Facts) -> DataFrame:
    """426: a group changed state in the last day."""
    changed = recent_change(f.state_changes, ["instance_id", "group_name"], "event_time", "24 HOURS", f.params.as_of)
    return raw(changed, 426, None, "group_name")


def health_session(f: Facts) -> DataFrame:
    """429: the health session is missing."""
    sessions = f.fleet["xe_sessions"].select("instance_id", fold("name").alias("session"))
    gone = required_set_missing(f.group_instances, [{"session": "alwayson_health"}], sessions, ["session"])
    return raw(gone, 429, None, F.lit("AlwaysOn_health"))


def endpoint_rights(f: Facts) -> DataFrame:
    """198, 199 as a row per instance: can the service account connect, and is it a sysadmin."""
    service = (f.services.where(fold("servicename").startswith("sql server ("))
               .groupBy("instance_id").agg(F.max("account_key").alias("account_key")))
    login = f.logins.groupBy("instance_id", F.col("login_key").alias("account_key")).agg(
        F.max("principal_id").alias("principal_id"), F.lit(True).alias("known"))
    # A Windows service account can be sysadmin by role row alone.
    sysadmin = f.sysadmins.select("instance_id", F.col("login_key").alias("account_key"), F.lit(True).alias("sys"))
    grants = (f.fleet["server_permissions"].where("class = 105 AND permission_name = 'CONNECT' AND state IN ('G', 'W')")
              .select("instance_id", F.col("grantee_principal_id").alias("principal_id"), F.col("major_id").alias("endpoint_id")))
    ep = f.fleet["endpoints"].where("type = 4").groupBy("instance_id").agg(F.max("endpoint_id").alias("endpoint_id"))
    granted = grants.join(ep, ["instance_id", "endpoint_id"], "left_semi").select("instance_id", "principal_id", F.lit(True).alias("granted")).distinct()
    rows = (f.in_groups(f.instances.select("instance_id", "can_connect_endpoint"))
            .join(service, "instance_id", "left").join(ep, "instance_id", "left")
            .join(login, ["instance_id", "account_key"], "left").join(sysadmin, ["instance_id", "account_key"], "left")
            .join(granted, ["instance_id", "principal_id"], "left"))
    direct = F.when(F.col("granted") | F.col("sys"), "Yes")
    tested = F.when(F.col("endpoint_id").isNotNull() & F.col("known"), F.coalesce("can_connect_endpoint", direct))
    return rows.select("instance_id", F.coalesce(tested, F.lit("Unknown")).alias("can_connect"),
                       F.when(F.col("sys"), "Yes").otherwise("No").alias("is_sysadmin"))


def endpoint_access(f: Facts) -> DataFrame:
    """432: the service account can neither connect to the endpoint nor is it a sysadmin."""
    return raw(endpoint_rights(f).where("can_connect = 'No' AND is_sysadmin = 'No'"), 432)


def group_profile(f: Facts) -> list[DataFrame]:
    return [endpoints(f), groups(f), replicas(f), replica_databases(f), quorum(f), mixed_modes(f), listeners(f), trace_flags(f),
            commit_waits(f), recent_state_changes(f), health_session(f), endpoint_access(f)]


def health_profile(f: Facts) -> list[DataFrame]:
    return [database_states(f), endpoints(f).where("check_id = 406"), groups(f).where("check_id = 407")]


