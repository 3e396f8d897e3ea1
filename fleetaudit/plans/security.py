"""Security checks (3xx)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fold, quote_name
from ..operators import (RowRule, SettingRule, credential_dictionary_audit, missing_coverage, ownership_audit,
                         privilege_audit, reclassify, resolve_securable, role_members, rule_scan, settings_rules,
                         settings_states)
from ..operators.scope import LAST_SYSTEM_ID
from .facts import Facts, raw, union

# States of a live grant, a login and an audit that come with a product, in key form: fixed values.
GRANTED = ("G", "W")
SHIPPED_LOGIN, SHIPPED_AUDIT = "l_certsignsmdetach", "sqlbeacon"


def roles(f: Facts) -> DataFrame:
    """301, 302: holders of the two strongest roles."""
    members = (f.fleet["server_role_members"].where(fold("role_name").isin("sysadmin", "securityadmin"))
               .select("instance_id", fold("role_name").alias("role"), fold("member_name").alias("login_key")).distinct())
    held = f.logins.join(members, ["instance_id", "login_key"]).where((F.col("sid") != f.sa) & ~F.col("deny_login"))
    name = F.col("name")
    quiet = fold("name").startswith("nt service\\") | (fold("name") == SHIPPED_LOGIN)
    return rule_scan(held, [RowRule(301, (F.col("role") == "sysadmin") & ~quiet, object=name),
                            RowRule(302, F.col("role") == "securityadmin", object=name)])


def server_permissions(f: Facts) -> DataFrame:
    """303, 354, 355: server-wide permissions held by logins."""
    live = F.col("state").isin(*GRANTED) & (F.col("class") == 100)
    internal = fold("name").startswith("##") & fold("name").endswith("##")
    on = [("instance_id", "instance_id"), ("principal_id", "grantee_principal_id")]

    def holders(check_id: int, test: Column) -> DataFrame:
        return raw(privilege_audit(f.fleet["server_principals"], f.fleet["server_permissions"], on, live & test, internal),
                   check_id, None, "name")

    permission = F.upper("permission_name")
    return union(holders(303, F.col("type") == "CL"), holders(354, permission == "IMPERSONATE ANY LOGIN"),
                 holders(355, permission == "ALTER ANY LOGIN"))


def sa_login(f: Facts) -> DataFrame:
    """307, 340: the built-in administrator is enabled or renamed."""
    name = F.col("name")
    sa = f.fleet["sql_logins"].where(F.col("sid") == f.sa)
    return rule_scan(sa, [RowRule(307, ~F.col("is_disabled"), object=name), RowRule(340, fold("name") != "sa", object=name)])


def passwords(f: Facts) -> DataFrame:
    """316-318: blank, own name, or the word itself. The words are fixed values."""
    weak = credential_dictionary_audit(f.fleet["sql_logins"], [("316", ""), ("318", "password")], own_name="317")
    return weak.select("instance_id", F.col("weakness").cast("int").alias("check_id"), F.lit(0).alias("case_no"),
                       F.lit(None).cast("string").alias("database_name"), F.col("name").alias("object_name"),
                       F.lit(None).cast("double").alias("metric"))


def invalid_logins(f: Facts) -> DataFrame:
    """304: Windows logins the directory no longer knows."""
    windows = f.fleet["server_principals"].where(F.col("type").isin("U", "G")).withColumn("key", fold("name"))
    known = f.fleet["directory_accounts"].withColumn("key", fold("account_name"))
    return raw(missing_coverage(windows, known, ["instance_id", "key"]), 304, None, quote_name("name"))


def local_administrators(f: Facts) -> DataFrame:
    """315, 351: members of the host's Administrators group, and services among them."""
    admins = f.fleet["local_admins"].select("instance_id", "account_name", "account_type", fold("account_name").alias("account_key"))
    all_members = raw(admins, 315, None, F.concat_ws(" ", "account_type", "account_name"))
    services = f.services.where(F.col("kind").isNotNull()).join(admins, ["instance_id", "account_key"])
    return union(all_members, raw(services, 351, None, "account_name", None, F.when(F.col("kind") == "agent", 1).otherwise(0)))


def services(f: Facts) -> DataFrame:
    """329, 350: services that run with too much power."""
    name = F.col("service_account")
    agent = F.when(F.col("kind") == "agent", 1).otherwise(0)
    strong = f.services.where(F.col("account_key").isin("localsystem", "nt authority\\system") & F.col("kind").isNotNull())
    roles_held = (f.services.where((F.col("kind") == "agent") | fold("servicename").startswith("sql server ("))
                  .join(f.sysadmins.withColumnRenamed("login_key", "account_key"), ["instance_id", "account_key"], "left_semi"))
    return union(raw(strong, 329, None, name, None, agent), raw(roles_held, 350, None, name, None, agent))


def proxies(f: Facts) -> DataFrame:
    """352, 353: proxy accounts."""
    credentials = f.fleet["credentials"].drop("snapshot_ts").withColumnRenamed("name", "credential")
    used = (f.fleet["proxies"].drop("snapshot_ts").where("enabled").join(credentials, ["instance_id", "credential_id"])
            .withColumn("login_key", fold("credential_identity")).join(f.sysadmins, ["instance_id", "login_key"], "left_semi"))
    shell = credentials.where(fold("credential") == "##xp_cmdshell_proxy_account##")
    return union(raw(used, 352, None, F.concat_ws(" ", "name", "credential_identity")), raw(shell, 353, None, "credential_identity"))


def settings_on(f: Facts) -> DataFrame:
    """309, 319-322: risky settings that are on. 309 spares instances that hold the catalog database."""
    rules = [SettingRule(309, "clr enabled", "=", 1, versions=(None, 13.9)), SettingRule(309, "clr enabled", "=", 1, 1, versions=(14, None)),
             SettingRule(319, "xp_cmdshell", "=", 1), SettingRule(320, "Ole Automation Procedures", "=", 1),
             SettingRule(321, "cross db ownership chaining", "=", 1), SettingRule(322, "Ad Hoc Distributed Queries", "=", 1)]
    settings = f.fleet["configurations"].join(f.gate.select("instance_id", "major"), "instance_id")
    found = settings_rules(settings, rules, version="major")
    spared = (f.fleet["databases"].where(fold("name") == "ssisdb")
              .select("instance_id", F.lit(309).alias("check_id")).distinct())
    return found.join(spared, ["instance_id", "check_id"], "left_anti")


# Settings whose state is reported whatever it is: fixed values.
REPORTED = [(310, "remote admin connections"), (311, "Database Mail XPs"), (341, "c2 audit mode"),
            (342, "common criteria compliance enabled"), (343, "contained database authentication"), (345, "remote access")]


def settings_reported(f: Facts) -> DataFrame:
    """310, 311, 341-343, 345: state of a setting, whatever it is."""
    found = settings_rules(f.fleet["configurations"], [SettingRule(i, n, "any") for i, n in REPORTED])
    return found.withColumn("object_name", F.when(F.col("metric") == 1, "ENABLED").otherwise("DISABLED"))


def registry_states(f: Facts) -> DataFrame:
    """347-349: state of three host settings, unknown when not exported."""
    return settings_states(f.fleet["instances"], f.fleet["registry_settings"],
                           [(347, "HideInstance"), (348, "ExtendedProtection"), (349, "ForceEncryption")])


def audit_level(f: Facts) -> DataFrame:
    """330: failed logins are not recorded."""
    level = f.fleet["registry_settings"].withColumn("level", F.col("value").try_cast("double"))
    return settings_rules(level, [SettingRule(330, "AuditLevel", "<", 2)], name="key", value="level")


def failed_logins(f: Facts) -> DataFrame:
    """331: number of failed logins in the log."""
    return raw(f.log_facts.where("failed_logins > 0"), 331, None, None, "failed_logins")


def remote_admin_off(f: Facts) -> DataFrame:
    """310 of the health profile: only when off."""
    return settings_rules(f.fleet["configurations"], [SettingRule(310, "remote admin connections", "=", 0)])


def linked_servers(f: Facts) -> DataFrame:
    """323-325: how linked servers sign in, six cases in one pass."""
    people = f.fleet["server_principals"].select("instance_id", F.col("principal_id").alias("local_principal_id"),
                                                 F.col("name").alias("mapped"))
    rows = (f.fleet["linked_servers"].drop("snapshot_ts").where("is_linked")
            .join(f.fleet["linked_logins"].drop("snapshot_ts"), ["instance_id", "server_id"])
            .join(people, ["instance_id", "local_principal_id"], "left"))
    every = F.col("local_principal_id") == 0
    own, remote = F.col("uses_self_credential"), F.col("remote_name")
    mapped = (F.col("local_principal_id") != 0) & F.col("mapped").isNotNull()
    what = F.concat_ws(" ", "name", "data_source", F.coalesce("product", "provider"), F.when(mapped, F.col("mapped")), remote)
    return rule_scan(rows, [
        RowRule(323, every & ~own & (fold("remote_name") == "sa"), object=what),
        RowRule(324, every & ~own & (fold("remote_name") != "sa"), object=what),
        RowRule(325, every & own & remote.isNull(), object=what),
        RowRule(325, every & ~own & remote.isNull(), object=what, case_no=1),
        RowRule(325, mapped & ~own & remote.isNotNull(), object=what, case_no=2),
        RowRule(325, mapped & own, object=what, case_no=3),
    ])


def startup_code(f: Facts) -> DataFrame:
    """313, 314: procedures and jobs that run at startup."""
    procs = f.fleet["routines"].where("is_startup")
    jobs = (f.fleet["schedules"].where("freq_type = 64 AND enabled").select("instance_id", "schedule_id")
            .join(f.fleet["job_schedules"].select("instance_id", "schedule_id", "job_id"), ["instance_id", "schedule_id"])
            .join(f.fleet["jobs"].where("enabled").select("instance_id", "job_id", "name"), ["instance_id", "job_id"]))
    return union(raw(procs, 313, None, F.concat_ws(".", "routine_schema", "routine_name")), raw(jobs, 314, None, "name"))


def audits(f: Facts) -> DataFrame:
    """326: audits that run."""
    running = f.fleet["audits"].where((F.col("status") == 1) & ~fold("name").contains(SHIPPED_AUDIT))
    return raw(running, 326, None, "name")


def encryption(f: Facts) -> DataFrame:
    """312: user databases by key (case 0) and their number without a key (case 1)."""
    keys = f.fleet["encryption_keys"].where(F.col("database_id") > LAST_SYSTEM_ID)
    by_key = keys.groupBy("instance_id", "key_algorithm", "key_length").agg(F.count(F.lit(1)).alias("n"))
    plain = (f.fleet["databases"].where((F.col("database_id") > LAST_SYSTEM_ID) & F.col("source_database_id").isNull())
             .join(f.fleet["encryption_keys"].select("instance_id", "database_id"), ["instance_id", "database_id"], "left_anti")
             .groupBy("instance_id").agg(F.count(F.lit(1)).alias("n")))
    all_plain = f.gate.select("instance_id").join(plain, "instance_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return union(raw(by_key, 312, None, F.concat_ws(" ", "key_algorithm", "key_length"), "n"), raw(all_plain, 312, None, None, "n", 1))


def owners(f: Facts, unknown_snapshots: bool = False) -> DataFrame:
    """305, 308, 327, 328, 332, 344, 346: database owners and the flags that depend on them, one join and one scan.

    An owner that no login matches gives neither 308 nor 332.
    """
    p = f.params
    owned = ownership_audit(f.databases, f.logins, carry=("name", "type", "is_sysadmin")).join(
        f.gate.select("instance_id", "major"), "instance_id")
    db, owner = F.col("name"), F.col("owner_name")
    user, no_snapshot = F.col("database_id") > LAST_SYSTEM_ID, F.col("source_database_id").isNull()
    trusted, sysadmin = F.col("is_trustworthy_on"), F.col("owner_is_sysadmin")
    rules = [
        RowRule(305, ~F.col("owner_known") & (F.lit(unknown_snapshots) | no_snapshot), db),
        RowRule(308, user & trusted & sysadmin, db, owner),
        RowRule(328, user & no_snapshot & sysadmin, db, owner),
        RowRule(332, user & trusted & ~sysadmin, db, owner),
        RowRule(344, (F.col("containment") > 0) & (F.col("major") >= 11), db),
        RowRule(346, no_snapshot & (F.col("owner_type") == "U"), db, owner),
    ]
    if p.preferred_owner is not None:
        system = F.col("db_key").isin("master", "model", "msdb", "tempdb")
        wrong = F.when(system, F.col("owner_sid") != f.sa).otherwise(fold("owner_name") != p.preferred_owner.lower())
        rules.append(RowRule(327, no_snapshot & F.col("owner_known") & wrong, db, owner))
    return rule_scan(owned, rules)


def owner_discrepancy(f: Facts) -> DataFrame:
    """306: the owner inside a database is not the one the instance records."""
    dbs = f.databases.where((F.col("state") == 0) & F.col("source_database_id").isNull() & (F.col("db_key") != "tempdb")
                            & (F.col("updateability") == "READ_WRITE"))
    inside = f.fleet["db_principals"].where("principal_id = 1").select(
        "instance_id", fold("database_name").alias("db_key"), F.col("sid").alias("inner_sid"))
    owned = ownership_audit(dbs.join(inside, ["instance_id", "db_key"]), f.logins)
    return raw(owned.where(F.col("owner_known") & (F.col("inner_sid") != F.col("owner_sid"))), 306, "name", "owner_name")


def database_roles(f: Facts) -> DataFrame:
    """333-337: members of strong database roles; system databases weigh more; roles inside fixed roles."""
    keys = ["instance_id", "db_key"]
    people = f.fleet["db_principals"].withColumn("db_key", fold("database_name"))
    links = f.fleet["db_role_members"].withColumn("db_key", fold("database_name"))
    listed = f.readable_databases.select("instance_id", "db_key", F.col("name").alias("database_name"))
    members = role_members(people, links, keys).join(listed, keys)
    db, role = F.col("database_name"), fold("role_name")
    who = F.concat_ws(" in ", "member_name", "role_name")
    not_dbo = fold("member_name") != "dbo"
    fixed = F.col("role_id").between(16384, 16393)  # ids of fixed database roles: fixed values
    found = rule_scan(members, [
        RowRule(333, not_dbo & (role == "db_owner"), db, who),
        RowRule(335, not_dbo & role.isin("db_accessadmin", "db_securityadmin", "db_ddladmin"), db, who),
        RowRule(337, (F.col("member_type") == "R") & fixed & (fold("member_name") != "rsexecrole") & (F.col("db_key") != "tempdb"), db, who),
    ])
    system = fold("database_name").isin("master", "msdb")
    return reclassify(found, [(333, system, 334), (335, system, 336)])


def orphaned_users(f: Facts) -> DataFrame:
    """338: database users whose login is gone."""
    users = (f.fleet["db_principals"].drop("snapshot_ts").withColumn("db_key", fold("database_name")).drop("database_name")
             .where((F.col("type") == "S") & (F.col("principal_id") != 2) & F.col("sid").isNotNull()
                    & (F.length("sid") <= 58))  # 28 bytes in hex with its prefix
             .join(f.readable_databases.where("db_key <> 'tempdb'").select("instance_id", "db_key", F.col("name").alias("database_name")),
                   ["instance_id", "db_key"])
             .join(f.gate.select("instance_id", "major"), "instance_id")
             .where((F.col("major") < 12) | (F.col("authentication_type_desc") == "INSTANCE")))
    return raw(missing_coverage(users, f.fleet["server_principals"], ["instance_id", "sid"]), 338, "database_name", "name")


def public_permissions(f: Facts) -> DataFrame:
    """339: permissions of the public role beyond the two every database grants."""
    standard = F.col("permission_name").isin("VIEW ANY COLUMN ENCRYPTION KEY DEFINITION", "VIEW ANY COLUMN MASTER KEY DEFINITION")
    usual = (F.col("class") == 0) & (F.col("major_id") == 0) & (F.col("minor_id") == 0) & standard
    grants = (f.fleet["db_permissions"].drop("snapshot_ts").withColumn("db_key", fold("database_name")).drop("database_name")
              .where((F.col("grantee_principal_id") == 0) & (F.col("class") != 1) & F.col("state").isin(*GRANTED) & ~usual)
              .join(f.readable_databases.where(F.col("database_id") > LAST_SYSTEM_ID)
                    .select("instance_id", "db_key", F.col("name").alias("database_name")), ["instance_id", "db_key"]))
    objects = f.fleet["securables"].withColumn("db_key", fold("database_name"))
    named = resolve_securable(grants, objects, ["instance_id", "db_key"])
    return raw(named, 339, "database_name", F.concat_ws(" on ", "permission_name", "object_name"))


def endpoint_owner(f: Facts) -> DataFrame:
    """406 of the security profile: the owner is neither a service account nor the built-in administrator."""
    own = f.endpoints.where("principal_id <> 1").withColumn("account_key", fold("owner_name"))
    return raw(missing_coverage(own, f.services, ["instance_id", "account_key"]), 406, None, F.concat_ws(" ", "name", "owner_name"))


def tempdb_encrypted(f: Facts) -> DataFrame:
    """356."""
    return raw(f.fleet["databases"].where((fold("name") == "tempdb") & F.col("is_encrypted")), 356, "name")


def security_profile(f: Facts) -> list[DataFrame]:
    parts = [roles(f), server_permissions(f), sa_login(f), passwords(f), invalid_logins(f), services(f), proxies(f),
             settings_on(f), settings_reported(f), registry_states(f), audit_level(f), failed_logins(f), linked_servers(f),
             startup_code(f), audits(f), encryption(f), owners(f), owner_discrepancy(f), database_roles(f),
             orphaned_users(f), public_permissions(f), endpoint_owner(f)]
    return parts + [local_administrators(f)] if f.params.check_local_admins else parts


def health_profile(f: Facts) -> list[DataFrame]:
    return [f.only(invalid_logins(f), "collected_as_sysadmin"),
            owners(f, unknown_snapshots=True).where("check_id = 305"), owner_discrepancy(f),
            sa_login(f).where("check_id = 307"), remote_admin_off(f)]
