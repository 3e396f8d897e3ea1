"""The checks of the audit over the derived fleet, by category and profile.

Each query runs a profile's checks of one category; its SQL states every check on its own, so the
shared scans and aggregates of the plans are compared with one plain statement per check.
"""
from __future__ import annotations

from dataclasses import replace
from functools import cache

from pyspark.sql import DataFrame, functions as F

from ..functions.stage import staged_union
from ..params import AuditParams
from ..plans import Facts, findings_of
from ..plans.assessment import assess
from ..plans import availability, discovery, integrity, performance, recoverability, reliability, security
from ..plans.catalogue import rules_for
from ..plans.facts import union
from ..operators.report import rule_dimension
from .derived_fleet import AS_OF, HELPERS, derived_fleet, with_tables
from .registry import Tables, query

PARAMS = AuditParams(AS_OF, start="1999-08-02 00:00:00", objective_minutes=100000, preferred_owner="sa", check_local_admins=True)
NOW = f"TIMESTAMP '{AS_OF}'"
START = "TIMESTAMP '1999-08-02 00:00:00'"
GOOD_STATE = "state NOT IN (1, 6, 10) AND NOT is_in_standby AND source_database_id IS NULL"

HELPERS.update({
    "inst": "SELECT *, CAST(regexp_extract(product_version, '^([0-9]+[.][0-9])', 1) AS DOUBLE) AS major, "
            "CAST(split_part(product_version, '.', 3) AS INTEGER) AS build, engine_edition = 8 AS managed FROM instances",
    "vnames": "SELECT * FROM (VALUES (10.0, '2008'), (10.5, '2008 R2'), (11.0, '2012'), (12.0, '2014'), (13.0, '2016'), (14.0, '2017'), "
              "(15.0, '2019'), (16.0, '2022'), (17.0, '2025')) v(num, vname)",
    "elig": f"""SELECT d.*, CASE WHEN i.major >= 11 AND NOT i.managed THEN m.group_name END AS group_name,
        CASE WHEN i.major >= 11 AND NOT i.managed THEN m.is_preferred_backup_replica END AS pref
        FROM databases d JOIN inst i USING (instance_id) LEFT JOIN ag_membership m ON m.instance_id = d.instance_id AND lower(m.database_name) = lower(d.name)
        WHERE d.database_id <> 2 AND {GOOD_STATE} AND ((i.major >= 11 AND NOT i.managed) OR d.database_id > 4)""",
    "lastb": """SELECT b.instance_id, lower(b.database_name) AS dbk, b.type, max(b.backup_start_date) AS last_at FROM backup_sets b JOIN inst i USING (instance_id)
        WHERE backup_finish_date IS NOT NULL AND lower(coalesce(b.server_name, i.server_name_prop)) = lower(i.server_name_prop) GROUP BY ALL""",
    "hist": f"""SELECT b.*, m.family_sequence_number, m.physical_device_name, m.logical_device_name, d.database_id, d.name AS current_name,
        CASE m.device_type WHEN 2 THEN 'Disk' WHEN 5 THEN 'Tape' WHEN 7 THEN 'Virtual Device' WHEN 9 THEN 'Azure Storage' WHEN 105 THEN 'A permanent Backup Device' ELSE 'UNKNOWN' END AS device_text
        FROM backup_sets b JOIN inst i USING (instance_id) JOIN backup_media m ON m.instance_id = b.instance_id AND m.media_set_id = b.media_set_id
        JOIN databases d ON d.instance_id = b.instance_id AND lower(d.name) = lower(b.database_name)
        WHERE lower(b.server_name) = lower(i.server_name_prop) AND d.database_id <> 2 AND {GOOD_STATE} AND b.backup_start_date >= {START} AND b.backup_start_date <= {NOW}""",
    "folders": """SELECT instance_id, backup_set_id, CASE WHEN left(physical_device_name, 1) = '{' THEN '{' || device_text || '}'
        ELSE coalesce(nullif(regexp_extract(physical_device_name, '^(.*\\\\)[^\\\\]+$', 1), ''), nullif(regexp_extract(physical_device_name, '^(.*/)[^/]+$', 1), '')) END AS folder
        FROM hist WHERE family_sequence_number = 1""",
    "located": "SELECT h.*, coalesce(p.folder, h.device_text) AS location FROM hist h JOIN folders p USING (instance_id, backup_set_id)",
    "failed": """SELECT DISTINCT instance_id, log_date, issue, regexp_replace(trim(regexp_extract(issue, 'BACKUP (DATABASE|LOG) ([^.]+)[.]$', 2)), '[][]', '', 'g') AS dbname
        FROM (SELECT instance_id, log_date, coalesce(nullif(regexp_extract(message, '^.*?BACKUP DATABASE [^.]+[.]'), ''), nullif(regexp_extract(message, '^.*?BACKUP LOG [^.]+[.]'), '')) AS issue
              FROM error_log WHERE message ILIKE '%BACKUP failed to complete the command BACKUP%') WHERE issue IS NOT NULL""",
    "logins": """SELECT p.*, EXISTS (SELECT 1 FROM server_role_members r WHERE r.instance_id = p.instance_id AND r.role_name = 'sysadmin' AND lower(r.member_name) = lower(p.name)) AS is_sys FROM server_principals p""",
    "sysa": "SELECT DISTINCT instance_id, lower(member_name) AS login FROM server_role_members WHERE role_name = 'sysadmin'",
    "svc": "SELECT *, CASE WHEN servicename LIKE 'SQL Server Agent%' THEN 'agent' ELSE 'engine' END AS kind FROM server_services",
    "readable": """SELECT d.* FROM databases d WHERE state = 0 AND source_database_id IS NULL AND NOT EXISTS (SELECT 1 FROM ag_databases a JOIN ag_replicas r
        ON r.instance_id = a.instance_id AND r.replica_id = a.replica_id WHERE a.instance_id = d.instance_id AND lower(a.database_name) = lower(d.name) AND a.is_local AND NOT a.is_primary_replica AND r.secondary_allow_desc = 'NO')""",
    "members": """SELECT m.instance_id, d.name AS dbname, r.name AS role, r.principal_id AS role_id, u.name AS usr, u.type AS utype FROM db_role_members m
        JOIN readable d ON d.instance_id = m.instance_id AND lower(d.name) = lower(m.database_name)
        JOIN db_principals r ON r.instance_id = m.instance_id AND lower(r.database_name) = lower(m.database_name) AND r.principal_id = m.role_principal_id
        JOIN db_principals u ON u.instance_id = m.instance_id AND lower(u.database_name) = lower(m.database_name) AND u.principal_id = m.member_principal_id""",
    "eps": "SELECT e.*, p.name AS owner_name, p.sid AS owner_sid, p.is_sys FROM endpoints e JOIN logins p ON p.instance_id = e.instance_id AND p.principal_id = e.principal_id WHERE e.type = 4",
    "grps": """SELECT g.*, p.name AS owner_name, i.major FROM ag_groups g JOIN inst i USING (instance_id) JOIN server_principals p ON p.instance_id = g.instance_id AND p.sid = g.owner_sid""",
    "reps": "SELECT r.*, CASE WHEN i.major >= 13 AND r.seeding_mode = 0 THEN 'AUTOMATIC' ELSE 'MANUAL' END AS seeding, replace(availability_mode_desc, '_', ' ') AS amode FROM ag_replicas r JOIN inst i USING (instance_id)",
    "adbs": "SELECT a.*, CASE WHEN i.major >= 13 THEN secondary_lag_seconds END AS lag, coalesce(synchronization_state_desc, 'NOT SYNCHRONIZING') AS sync FROM ag_databases a JOIN inst i USING (instance_id)",
    "ginst": "SELECT DISTINCT instance_id FROM ag_groups",
    "changes": """SELECT x.instance_id, x.object_name, CAST(regexp_extract(event_data, 'timestamp="([^"]+)Z"', 1) AS TIMESTAMP) + i.utc_offset_minutes * INTERVAL 1 MINUTE AS event_time,
        regexp_extract(event_data, 'availability_group_name"><value>([^<]*)<', 1) AS group_name, regexp_extract(event_data, 'previous_state"><value>1</value><text>([^<]*)<', 1) AS previous_state,
        regexp_extract(event_data, 'current_state"><value>2</value><text>([^<]*)<', 1) AS current_state FROM xe_events x JOIN instances i USING (instance_id)
        WHERE x.object_name = 'availability_replica_state_change' AND x.instance_id IN (SELECT instance_id FROM xe_sessions WHERE name = 'AlwaysOn_health')""",
    "odrv": "SELECT instance_id, count(DISTINCT drive) AS n FROM drives WHERE drive <> 'C' GROUP BY instance_id",
    "fdb": "SELECT f.*, d.name AS dbname, d.state AS dbstate, upper(left(f.physical_name, 1)) AS letter, f.physical_name ILIKE 'C:%' AS on_c FROM files f LEFT JOIN databases d ON d.instance_id = f.instance_id AND d.database_id = f.database_id",
    "online": "SELECT d.*, i.major FROM databases d JOIN inst i USING (instance_id) WHERE state = 0 AND database_id > 4",
    "freezes": """SELECT *, regexp_extract(message, 'on database (.*?)[.] No user', 1) AS dbname, message LIKE 'I/O is frozen%' AS frozen FROM error_log
        WHERE message LIKE 'I/O is frozen on database %' OR message LIKE 'I/O was resumed on database %'""",
    "pairs": """SELECT instance_id, dbname, (epoch_us(r) // 1000) - (epoch_us(log_date) // 1000) AS ms FROM (SELECT f.*, (SELECT min(r.log_date) FROM freezes r WHERE NOT r.frozen
        AND r.instance_id = f.instance_id AND r.dbname = f.dbname AND r.log_date > f.log_date) AS r FROM freezes f WHERE f.frozen) x WHERE r IS NOT NULL""",
})


def check(check_id: int, source: str, db: str = "NULL", obj: str = "NULL", metric: str = "NULL", case: int | str = 0, iid: str = "instance_id",
          distinct: bool = False, group: str | None = None) -> str:
    """One check as a plain statement: rows of ``source`` (what follows FROM) as raw findings."""
    return (f"SELECT {'DISTINCT ' if distinct else ''}{iid} AS instance_id, CAST({check_id} AS INTEGER) AS check_id, CAST({case} AS INTEGER) AS case_no, "
            f"CAST({db} AS VARCHAR) AS database_name, CAST({obj} AS VARCHAR) AS object_name, CAST({metric} AS DOUBLE) AS metric FROM {source}"
            + (f" GROUP BY {group}" if group else ""))


def all_of(*checks: str) -> str:
    return "\nUNION ALL ".join(checks)


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def second(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


@cache
def _statements() -> dict[str, list[str]]:
    """Statements by group; each group is one registered query."""
    out: dict[str, list[str]] = {}
    join_last = "elig e {} JOIN lastb l ON l.instance_id = e.instance_id AND l.dbk = lower(e.name) AND l.type = '{}'"
    any_last = "elig e LEFT JOIN (SELECT instance_id, dbk, max(last_at) AS at FROM lastb GROUP BY ALL) l ON l.instance_id = e.instance_id AND l.dbk = lower(e.name)"
    e = dict(iid="e.instance_id", db="e.name")
    missed = f"date_diff('minute', l.at, {NOW})"

    def certs(backup_id: int, expiry_id: int, src: str) -> list[str]:
        kw = dict(db="database_name", obj="name")
        return [check(backup_id, f"{src} WHERE pvt_key_last_backup_date IS NULL", **kw),
                check(backup_id, f"{src} WHERE pvt_key_last_backup_date <= {NOW} - INTERVAL 90 DAY", case=1, **kw),
                check(expiry_id, src, metric=f"date_diff('day', {NOW}, expiry_date)", **kw)]

    cert = certs(210, 212, "(SELECT DISTINCT c.*, b.database_name FROM certificates c JOIN backup_sets b ON b.instance_id = c.instance_id AND b.encryptor_thumbprint = c.thumbprint "
                           "JOIN inst i ON i.instance_id = c.instance_id WHERE i.major >= 12) x") + \
        certs(211, 213, "(SELECT c.*, d.name AS database_name FROM certificates c JOIN encryption_keys k ON k.instance_id = c.instance_id AND k.encryptor_thumbprint = c.thumbprint "
                        "LEFT JOIN databases d ON d.instance_id = k.instance_id AND d.database_id = k.database_id) x")
    coverage = [
        check(203, join_last.format("LEFT", "D") + " WHERE l.last_at IS NULL AND coalesce(pref, TRUE)", **e),
        check(204, join_last.format("LEFT", "L") + " WHERE l.last_at IS NULL AND coalesce(pref, TRUE) AND recovery_model_desc <> 'SIMPLE'", **e),
        check(205, join_last.format("", "D") + f" WHERE l.last_at <= {NOW} - INTERVAL 7 DAY AND coalesce(pref, TRUE)", **e),
        check(206, join_last.format("", "L") + f" WHERE l.last_at <= {NOW} - INTERVAL 24 HOUR AND coalesce(pref, TRUE) AND recovery_model_desc <> 'SIMPLE'", **e)]
    conf = "configurations WHERE lower(name) IN ('{0}', '{0} default') AND value_in_use = 0"
    cfg = dict(obj="name", metric="value_in_use")
    oldest = check(216, f"(SELECT instance_id, min(backup_start_date) AS first_at FROM backup_sets GROUP BY instance_id) x WHERE first_at <= {NOW} - INTERVAL 90 DAY",
                   obj=second("first_at"), metric=f"date_diff('day', first_at, {NOW})")
    vlf = "databases d JOIN db_log_stats s USING (instance_id, database_id) JOIN inst i USING (instance_id) WHERE total_vlf_count > 200 AND major >= 13"
    failed_text = dict(db="dbname", obj="strftime(log_date, '%m/%d/%Y') || ' ' || issue")
    out["recoverability_backup"] = coverage + cert + [
        check(208, conf.format("backup compression"), **cfg), check(209, conf.format("backup checksum") + " AND instance_id IN (SELECT instance_id FROM inst WHERE major > 11)", **cfg),
        check(214, f"{any_last} WHERE {missed} > 100000", metric=missed, **e), check(214, f"{any_last} WHERE l.at IS NULL", case=1, **e),
        check(202, "hist JOIN inst USING (instance_id) WHERE NOT has_backup_checksums AND NOT is_copy_only AND major > 11", db="database_name", metric="count(*)", group="instance_id, database_name"),
        check(215, "hist JOIN inst USING (instance_id) WHERE is_password_protected AND major < 11", db="database_name", distinct=True),
        check(218, "hist WHERE type = 'L' AND NOT is_copy_only AND upper(trim(physical_device_name)) IN ('NUL', 'NUL:')", db="database_name", obj=second("max(backup_start_date)"), metric="count(*)",
              group="instance_id, database_name"),
        check(201, "(SELECT instance_id, database_name, type, count(DISTINCT location) AS n FROM located WHERE NOT is_copy_only GROUP BY ALL) x WHERE n > 1", db="database_name",
              obj="CASE type WHEN 'D' THEN 'Full' WHEN 'I' THEN 'Differential' ELSE 'Transaction Log' END", metric="n"),
        check(207, f"failed WHERE log_date >= {START} AND log_date <= {NOW}", **failed_text), oldest,
        check(217, f"{vlf} AND state = 0 AND source_database_id IS NULL AND NOT is_in_standby AND updateability = 'READ_WRITE'", db="d.name", metric="total_vlf_count")]
    out["recoverability_health"] = coverage + cert + [
        check(208, conf.format("backup compression"), **cfg), check(209, conf.format("backup checksum"), **cfg), check(207, "failed", **failed_text), oldest,
        check(217, vlf, db="d.name", metric="total_vlf_count")]
    out["recoverability_security"] = cert

    perms = ("server_principals p WHERE EXISTS (SELECT 1 FROM server_permissions g WHERE g.instance_id = p.instance_id AND g.grantee_principal_id = p.principal_id "
             "AND g.state IN ('G', 'W') AND g.class = 100 AND {}) AND p.name NOT LIKE '##%##'")
    holders = "logins l JOIN server_role_members r ON r.instance_id = l.instance_id AND lower(r.member_name) = lower(l.name) AND r.role_name = '{}' WHERE l.sid <> '0x01' AND NOT l.deny_login"
    named = dict(iid="l.instance_id", obj="l.name", distinct=True)
    pwd = "sql_logins WHERE sha256(salt || {}) = digest"
    svc_case = dict(obj="service_account", case="CASE kind WHEN 'agent' THEN 1 ELSE 0 END")
    invalid = "server_principals p WHERE type IN ('U', 'G') AND NOT EXISTS (SELECT 1 FROM directory_accounts a WHERE a.instance_id = p.instance_id AND lower(a.account_name) = lower(p.name))"
    out["security_logins"] = [
        check(301, holders.format("sysadmin") + " AND l.name NOT ILIKE 'NT SERVICE%' AND l.name <> 'l_certSignSmDetach'", **named), check(302, holders.format("securityadmin"), **named),
        check(303, perms.format("g.type = 'CL'"), obj="name"), check(354, perms.format("g.permission_name = 'IMPERSONATE ANY LOGIN'"), obj="name"),
        check(355, perms.format("g.permission_name = 'ALTER ANY LOGIN'"), obj="name"),
        check(307, "sql_logins WHERE sid = '0x01' AND NOT is_disabled", obj="name"), check(340, "sql_logins WHERE sid = '0x01' AND lower(name) <> 'sa'", obj="name"),
        check(316, pwd.format("''"), obj="name"), check(317, pwd.format("name"), obj="name"), check(318, pwd.format("'password'"), obj="name"),
        check(304, invalid, obj="'[' || name || ']'"),
        check(315, "local_admins", obj="account_type || ' ' || account_name"),
        check(351, "svc s JOIN local_admins a ON a.instance_id = s.instance_id AND lower(a.account_name) = lower(s.service_account)", iid="s.instance_id", obj="account_name", case=svc_case["case"]),
        check(329, "svc WHERE lower(service_account) = 'localsystem' OR upper(service_account) = 'NT AUTHORITY' || chr(92) || 'SYSTEM'", **svc_case),
        check(350, "svc s WHERE EXISTS (SELECT 1 FROM sysa WHERE sysa.instance_id = s.instance_id AND login = lower(service_account))", **svc_case),
        check(352, "proxies p JOIN credentials c USING (instance_id, credential_id) WHERE p.enabled AND EXISTS (SELECT 1 FROM sysa WHERE sysa.instance_id = p.instance_id AND login = lower(credential_identity))",
              obj="p.name || ' ' || credential_identity"),
        check(353, "credentials WHERE name = '##xp_cmdshell_proxy_account##'", obj="credential_identity")]

    on = "configurations WHERE lower(name) = '{}' AND value_in_use = 1"
    clr = "configurations c JOIN inst i USING (instance_id) WHERE c.name = 'clr enabled' AND value_in_use = 1 AND major {} 14 AND NOT EXISTS (SELECT 1 FROM databases d WHERE d.instance_id = c.instance_id AND lower(d.name) = 'ssisdb')"
    state = dict(obj="CASE WHEN value_in_use = 1 THEN 'ENABLED' ELSE 'DISABLED' END", metric="value_in_use")
    reg = "instances i LEFT JOIN registry_settings r ON r.instance_id = i.instance_id AND r.key = '{}'"
    reg_state = dict(iid="i.instance_id", obj="CASE r.value WHEN '1' THEN 'ENABLED' WHEN '0' THEN 'DISABLED' ELSE 'UNKNOWN' END", metric="r.value")
    link = ("linked_servers s JOIN linked_logins l USING (instance_id, server_id) LEFT JOIN server_principals p ON p.instance_id = s.instance_id AND p.principal_id = l.local_principal_id WHERE s.is_linked AND ")
    link_text = "concat_ws(' ', s.name, s.data_source, coalesce(s.product, s.provider){}, l.remote_name)"
    every, mapped = dict(obj=link_text.format("")), dict(obj=link_text.format(", p.name"))
    out["security_settings"] = [
        check(309, clr.format("<"), **cfg), check(309, clr.format(">="), case=1, **cfg),
        *[check(i, on.format(n), **cfg) for i, n in ((319, "xp_cmdshell"), (320, "ole automation procedures"), (321, "cross db ownership chaining"), (322, "ad hoc distributed queries"))],
        *[check(i, f"configurations WHERE lower(name) = '{n}'", **state) for i, n in ((310, "remote admin connections"), (311, "database mail xps"), (341, "c2 audit mode"),
          (342, "common criteria compliance enabled"), (343, "contained database authentication"), (345, "remote access"))],
        *[check(i, reg.format(k), **reg_state) for i, k in ((347, "HideInstance"), (348, "ExtendedProtection"), (349, "ForceEncryption"))],
        check(330, "registry_settings WHERE key = 'AuditLevel' AND CAST(value AS INTEGER) < 2", obj="key", metric="value"),
        check(331, "error_log WHERE message ILIKE '%Login failed%'", metric="count(*)", group="instance_id"),
        check(323, link + "l.local_principal_id = 0 AND NOT uses_self_credential AND lower(remote_name) = 'sa'", **every),
        check(324, link + "l.local_principal_id = 0 AND NOT uses_self_credential AND lower(remote_name) <> 'sa'", **every),
        check(325, link + "l.local_principal_id = 0 AND uses_self_credential AND remote_name IS NULL", **every),
        check(325, link + "l.local_principal_id = 0 AND NOT uses_self_credential AND remote_name IS NULL", case=1, **every),
        check(325, link + "p.name IS NOT NULL AND l.local_principal_id <> 0 AND NOT uses_self_credential AND remote_name IS NOT NULL", case=2, **mapped),
        check(325, link + "p.name IS NOT NULL AND l.local_principal_id <> 0 AND uses_self_credential", case=3, **mapped),
        check(313, "routines WHERE is_startup", obj="routine_schema || '.' || routine_name"),
        check(314, "schedules s JOIN job_schedules x USING (instance_id, schedule_id) JOIN jobs j USING (instance_id, job_id) WHERE freq_type = 64 AND s.enabled AND j.enabled", obj="j.name"),
        check(326, "audits WHERE status = 1 AND name NOT ILIKE '%sqlbeacon%'", obj="name")]

    owner = "databases d LEFT JOIN logins l ON l.instance_id = d.instance_id AND l.sid = d.owner_sid"
    own = dict(iid="d.instance_id", db="d.name", obj="l.name")
    discrepancy = check(306, f"{owner} JOIN db_principals p ON p.instance_id = d.instance_id AND lower(p.database_name) = lower(d.name) AND p.principal_id = 1 "
                             "WHERE l.name IS NOT NULL AND p.sid <> d.owner_sid AND d.state = 0 AND d.source_database_id IS NULL AND d.updateability = 'READ_WRITE' AND d.name <> 'tempdb'", **own)
    system = "lower(d.name) IN ('master', 'model', 'msdb', 'tempdb')"
    in_sys = "lower(dbname) IN ('master', 'msdb')"
    who = dict(db="dbname", obj="usr || ' in ' || role")
    unusual = "members WHERE usr <> 'dbo' AND role IN ('db_accessadmin', 'db_securityadmin', 'db_ddladmin')"
    out["security_databases"] = [
        check(305, f"{owner} WHERE l.name IS NULL AND source_database_id IS NULL", iid="d.instance_id", db="d.name"), discrepancy,
        check(308, f"{owner} WHERE database_id > 4 AND is_trustworthy_on AND l.is_sys", **own), check(332, f"{owner} WHERE database_id > 4 AND is_trustworthy_on AND NOT l.is_sys", **own),
        check(327, f"{owner} WHERE source_database_id IS NULL AND (({system} AND l.sid <> '0x01') OR (NOT {system} AND lower(l.name) <> 'sa'))", **own),
        check(328, f"{owner} WHERE l.is_sys AND database_id > 4 AND source_database_id IS NULL", **own),
        check(344, "databases d JOIN inst i USING (instance_id) WHERE containment > 0 AND major >= 11", db="d.name"),
        check(346, f"{owner} WHERE l.type = 'U' AND source_database_id IS NULL", **own),
        check(333, f"members WHERE usr <> 'dbo' AND role = 'db_owner' AND NOT {in_sys}", **who), check(334, f"members WHERE usr <> 'dbo' AND role = 'db_owner' AND {in_sys}", **who),
        check(335, f"{unusual} AND NOT {in_sys}", **who), check(336, f"{unusual} AND {in_sys}", **who),
        check(337, "members WHERE utype = 'R' AND role_id BETWEEN 16384 AND 16393 AND usr <> 'RSExecRole' AND dbname <> 'tempdb'", **who),
        check(338, "db_principals u JOIN readable d ON d.instance_id = u.instance_id AND lower(d.name) = lower(u.database_name) JOIN inst i ON i.instance_id = u.instance_id "
                   "WHERE u.type = 'S' AND principal_id <> 2 AND (length(sid) - 2) / 2 <= 28 AND d.name <> 'tempdb' AND (major < 12 OR authentication_type_desc = 'INSTANCE') "
                   "AND NOT EXISTS (SELECT 1 FROM server_principals s WHERE s.instance_id = u.instance_id AND s.sid = u.sid)", iid="u.instance_id", db="d.name", obj="u.name"),
        check(339, "db_permissions g JOIN readable d ON d.instance_id = g.instance_id AND lower(d.name) = lower(g.database_name) LEFT JOIN securables s ON s.instance_id = g.instance_id "
                   "AND s.database_name = g.database_name AND s.class = g.class AND s.id = g.major_id WHERE grantee_principal_id = 0 AND g.class <> 1 AND g.state IN ('G', 'W') AND d.database_id > 4 "
                   "AND NOT (g.class = 0 AND major_id = 0 AND minor_id = 0 AND permission_name LIKE 'VIEW ANY COLUMN%DEFINITION')", iid="g.instance_id", db="d.name",
              obj="concat_ws(' on ', permission_name, s.name)"),
        check(312, "encryption_keys WHERE database_id > 4", obj="key_algorithm || ' ' || key_length", metric="count(*)", group="instance_id, key_algorithm, key_length"),
        check(312, "instances i", iid="i.instance_id", case=1, metric="(SELECT count(*) FROM databases d WHERE d.instance_id = i.instance_id AND database_id > 4 AND source_database_id IS NULL "
              "AND NOT EXISTS (SELECT 1 FROM encryption_keys k WHERE k.instance_id = d.instance_id AND k.database_id = d.database_id))"),
        check(406, "eps WHERE principal_id <> 1 AND NOT EXISTS (SELECT 1 FROM svc WHERE svc.instance_id = eps.instance_id AND lower(service_account) = lower(owner_name))", obj="name || ' ' || owner_name"),
        check(356, "databases WHERE name = 'tempdb' AND is_encrypted", db="name")]
    sysadmin_only = " AND instance_id IN (SELECT instance_id FROM inst WHERE collected_as_sysadmin)"
    out["security_health"] = [check(304, invalid + sysadmin_only.replace("AND instance_id", "AND p.instance_id"), obj="'[' || name || ']'"),
                              check(305, f"{owner} WHERE l.name IS NULL", iid="d.instance_id", db="d.name"), discrepancy,
                              check(307, "sql_logins WHERE sid = '0x01' AND NOT is_disabled", obj="name"),
                              check(310, "configurations WHERE name = 'remote admin connections' AND value_in_use = 0", **cfg)]

    out["availability_databases"] = [check(i, f"databases WHERE {w}", db="name") for i, w in (
        (401, "user_access_desc = 'SINGLE_USER'"), (402, "user_access_desc = 'RESTRICTED_USER'"), (403, "is_read_only AND source_database_id IS NULL"), (404, "state = 6"), (405, "state = 4"))] + [
        check(406, "eps WHERE owner_sid <> '0x01'", obj="name || ' ' || owner_name"), check(407, "grps WHERE owner_sid <> '0x01'", obj="group_name || ' ' || owner_name")]
    sysadmin = " AND instance_id IN (SELECT instance_id FROM inst WHERE collected_as_sysadmin)"
    grouped = " AND instance_id IN (SELECT instance_id FROM ginst)"
    rep = "group_name || ' ' || server_instance"
    both = "adbs a JOIN reps r ON r.instance_id = a.instance_id AND r.replica_id = a.replica_id"
    on_rep = "a.group_name || ' ' || r.server_instance"
    mixed = "(SELECT DISTINCT instance_id, group_name FROM grps) g WHERE (SELECT count(DISTINCT {}) FROM reps r WHERE r.instance_id = g.instance_id AND r.group_name = g.group_name) > 1"
    ab = dict(iid="a.instance_id", db="a.database_name")
    member = "instances i JOIN (SELECT instance_id, sum(CASE WHEN member_state_desc = 'UP' AND number_of_quorum_votes > 0 THEN 1 ELSE 0 END) AS up, sum(number_of_quorum_votes) AS votes FROM cluster_members GROUP BY instance_id) c USING (instance_id)"
    out["availability_groups"] = [
        check(406, "eps WHERE owner_sid <> '0x01'", obj="name || ' ' || owner_name"), check(407, "grps WHERE owner_sid <> '0x01'", obj="group_name || ' ' || owner_name"),
        check(408, member + " WHERE up < 3", obj="cluster_name", metric="up"), check(409, member + " WHERE votes < 3", obj="cluster_name", metric="votes"),
        check(410, "cluster_members WHERE member_state_desc <> 'UP'", obj="member_name"), check(411, "eps WHERE state_desc <> 'STARTED'", obj="name"),
        check(412, mixed.format("seeding"), obj="group_name"), check(427, mixed.format("failover_mode_desc"), obj="group_name"),
        check(413, "adbs a WHERE NOT coalesce(is_database_joined, FALSE)", db="database_name", obj="group_name"), check(414, "adbs a WHERE is_suspended", db="database_name", obj="group_name"),
        check(415, "reps WHERE session_timeout = 10", obj=rep, metric="session_timeout"), check(415, "reps WHERE session_timeout < 10", obj=rep, metric="session_timeout", case=1),
        check(416, "grps WHERE upper(backup_preference_desc) <> 'PRIMARY'", obj="group_name || ' ' || upper(backup_preference_desc)"),
        check(417, "ag_listeners l WHERE NOT EXISTS (SELECT 1 FROM ag_listeners o WHERE o.instance_id = l.instance_id AND o.dns_name = l.dns_name AND o.ip_state = 'ONLINE')",
              obj="concat_ws(' ', dns_name, ip_address, ip_state)"),
        check(418, "reps WHERE seeding = 'AUTOMATIC'", obj=rep), check(419, "trace_flags WHERE trace_flag = '9567'" + grouped, obj="trace_flag"), check(425, "trace_flags WHERE trace_flag = '1800'" + grouped, obj="trace_flag"),
        check(420, "eps WHERE certificate_expiry IS NOT NULL" + sysadmin, obj=f"concat_ws(' ', name, coalesce(certificate_name, '(Windows Authentication)'), {day('certificate_expiry')})"),
        check(421, f"{both} WHERE NOT coalesce(is_failover_ready, FALSE) AND failover_mode_desc = 'AUTOMATIC'", obj=on_rep, **ab),
        check(422, "wait_stats WHERE wait_type = 'HADR_SYNC_COMMIT' AND wait_time_ms / (waiting_tasks_count + 1) > 5.0" + grouped, obj="wait_type", metric="wait_time_ms / (waiting_tasks_count + 1)"),
        check(423, f"{both} AND r.group_id = a.group_id WHERE lag > 5", obj=on_rep, metric="lag", **ab),
        check(424, "grps WHERE health_check_timeout = 30000", obj="group_name", metric="health_check_timeout"), check(424, "grps WHERE health_check_timeout < 30000", obj="group_name", metric="health_check_timeout", case=1),
        check(426, f"changes WHERE group_name IS NOT NULL GROUP BY instance_id, group_name HAVING max(event_time) > {NOW} - INTERVAL 24 HOUR", obj="group_name"),
        check(428, "cluster_members m WHERE (SELECT count(DISTINCT failover_mode_desc) FROM reps r WHERE r.instance_id = m.instance_id AND lower(split_part(r.server_instance, chr(92), 1)) = lower(m.member_name)) > 1", obj="member_name"),
        check(429, "ginst g WHERE NOT EXISTS (SELECT 1 FROM xe_sessions x WHERE x.instance_id = g.instance_id AND x.name = 'AlwaysOn_health')", obj="'AlwaysOn_health'"),
        check(430, f"{both} AND r.group_id = a.group_id WHERE amode = 'SYNCHRONOUS COMMIT' AND sync <> 'SYNCHRONIZED'", obj=f"{on_rep} || ' ' || sync", **ab),
        check(431, "reps WHERE connected_state_desc = 'DISCONNECTED'", obj=rep),
        check(432, "rights WHERE can_connect = 'No' AND is_sysadmin = 'No'")]
    HELPERS["rights"] = """SELECT i.instance_id, CASE WHEN EXISTS (SELECT 1 FROM endpoints e WHERE e.instance_id = i.instance_id AND e.type = 4)
          AND EXISTS (SELECT 1 FROM server_principals p WHERE p.instance_id = i.instance_id AND lower(p.name) = lower(s.service_account))
        THEN coalesce(i.can_connect_endpoint, CASE WHEN EXISTS (SELECT 1 FROM server_permissions g JOIN server_principals p ON p.instance_id = g.instance_id AND p.principal_id = g.grantee_principal_id
            JOIN endpoints e ON e.instance_id = g.instance_id AND e.endpoint_id = g.major_id
            WHERE g.instance_id = i.instance_id AND g.class = 105 AND g.permission_name = 'CONNECT' AND g.state IN ('G', 'W') AND lower(p.name) = lower(s.service_account))
          OR EXISTS (SELECT 1 FROM sysa WHERE sysa.instance_id = i.instance_id AND login = lower(s.service_account)) THEN 'Yes' ELSE 'Unknown' END) ELSE 'Unknown' END AS can_connect,
        CASE WHEN EXISTS (SELECT 1 FROM sysa WHERE sysa.instance_id = i.instance_id AND login = lower(s.service_account)) THEN 'Yes' ELSE 'No' END AS is_sysadmin
        FROM instances i JOIN ginst USING (instance_id) LEFT JOIN svc s ON s.instance_id = i.instance_id AND s.kind = 'engine'"""

    dbcc = (f"(SELECT DISTINCT d.instance_id, d.name, CAST(x.value AS TIMESTAMP) AS checked FROM db_info x JOIN databases d ON d.instance_id = x.instance_id AND lower(d.name) = lower(x.database_name) "
            f"WHERE field = 'dbi_dbccLastKnownGood' AND d.state = 0 AND d.source_database_id IS NULL AND d.updateability = 'READ_WRITE' AND NOT d.is_read_only AND d.name <> 'tempdb') x WHERE checked < {NOW} - INTERVAL 14 DAY")
    known_good = check(503, dbcc, db="name", obj=day("checked"))
    alert = "inst i CROSS JOIN (VALUES {}) v(code) WHERE engine_edition IN (2, 3, 8) AND collected_as_sysadmin AND NOT EXISTS (SELECT 1 FROM alerts a WHERE a.instance_id = i.instance_id AND a.{} = v.code)"
    out["integrity_health"] = [
        check(501, "online WHERE page_verify_option_desc <> 'CHECKSUM'", db="name", obj="page_verify_option_desc"),
        check(502, alert.format("(19), (20), (21), (22), (23), (24), (25)", "severity"), obj="'severity ' || code"), check(502, alert.format("(823), (824), (825)", "message_id"), obj="'message ' || code"),
        known_good, check(504, f"suspect_pages s JOIN databases d USING (instance_id, database_id) WHERE last_update_date >= {NOW} - INTERVAL 30 DAY", db="d.name", obj=second("last_update_date"), metric="error_count"),
        check(505, "alerts WHERE NOT enabled" + sysadmin, obj="name")]
    out["integrity_groups"] = [
        check(504, "suspect_pages s LEFT JOIN databases d USING (instance_id, database_id) WHERE event_type IN (1, 2, 3) AND EXISTS (SELECT 1 FROM ag_databases a WHERE a.instance_id = s.instance_id AND a.database_id = s.database_id AND a.is_local)",
              db="d.name", obj=f"CAST(sum(error_count) AS BIGINT) || ' ' || {second('max(last_update_date)')}", metric="count(*)", group="instance_id, database_id, d.name"),
        check(506, "page_repairs s LEFT JOIN databases d USING (instance_id, database_id) WHERE s.instance_id IN (SELECT instance_id FROM ginst)", db="d.name", obj=second("max(modification_time)"), metric="count(*)",
              group="instance_id, database_id, d.name")]

    ver = "inst i JOIN vnames v ON v.num = i.major"
    patched = "inst i JOIN vnames v ON v.num = i.major JOIN (VALUES (11.0, 7507), (12.0, 6449), (13.0, 6500), (14.0, 3540), (15.0, 4480), (16.0, 4262), (17.0, 4060)) p(num, minimum) ON p.num = i.major WHERE NOT managed AND build < minimum"
    versions = [check(601, patched, obj="vname", metric="build"), check(602, ver + " WHERE NOT managed AND major < 13", obj="vname", metric="major")]
    uptime = check(603, f"databases WHERE database_id = 2 AND create_date < {NOW} - INTERVAL 180 DAY", obj="strftime(create_date, '%m/%d/%Y')")
    other = "fdb f LEFT JOIN odrv o USING (instance_id) WHERE "
    fkw, tkw = dict(db="dbname", obj="f.name"), dict(db="'tempdb'", obj="f.name")
    no_growth = check(605, "files f WHERE database_id = 2 AND growth = 0", **tkw)
    user_jobs = "jobs j JOIN server_principals p ON p.instance_id = j.instance_id AND p.sid = j.owner_sid WHERE j.enabled AND j.owner_sid <> '0x01' AND p.name NOT LIKE '##%'"
    job_owner = dict(iid="j.instance_id", obj="j.name || ' ' || p.name")
    agent = check(628, "svc s JOIN instances i USING (instance_id) WHERE kind = 'agent' AND status_desc <> 'Running' AND edition NOT ILIKE '%xpress%'", obj="servicename || ' ' || startup_type_desc")
    paths = [check(n, f"instances i JOIN odrv o USING (instance_id) WHERE upper(left({c}, 1)) = 'C' AND o.n > 0", obj=c) for n, c in ((612, "data_path"), (613, "log_path"), (614, "backup_path"))]
    names_differ = "instances WHERE lower(server_name_var) <> lower(server_name_prop)"
    logs = "registry_settings WHERE key = 'NumErrorLogs'"
    out["reliability_health"] = versions + paths + [
        uptime, agent, no_growth, check(604, other + "database_id = 2 AND on_c AND o.n > 0", **tkw), check(606, other + "database_id > 4 AND on_c AND o.n > 0", **fkw),
        check(607, "fdb f WHERE database_id > 4 AND growth = 0", **fkw),
        check(608, "fdb d JOIN fdb l ON l.instance_id = d.instance_id AND l.database_id = d.database_id AND l.letter = d.letter JOIN odrv o ON o.instance_id = d.instance_id "
                   "WHERE d.type_desc = 'ROWS' AND l.type_desc = 'LOG' AND d.letter <> 'C' AND d.database_id > 4 AND d.dbstate = 0 AND o.n >= 2", iid="d.instance_id", db="d.dbname", distinct=True),
        check(609, "jobs j JOIN job_schedules x USING (instance_id, job_id) JOIN schedules s USING (instance_id, schedule_id) WHERE j.enabled AND NOT s.enabled" + sysadmin, obj="j.name || ' ' || s.name"),
        check(610, "jobs j LEFT JOIN job_schedules x USING (instance_id, job_id) LEFT JOIN schedules s USING (instance_id, schedule_id) WHERE j.enabled" + sysadmin + " GROUP BY instance_id, job_id, j.name HAVING count(s.enabled) = 0", obj="j.name"),
        check(611, user_jobs + sysadmin.replace("AND instance_id", "AND j.instance_id"), **job_owner),
        check(615, "configurations a JOIN configurations b USING (instance_id) WHERE a.name = 'min server memory (MB)' AND b.name = 'max server memory (MB)' AND a.value_in_use = b.value_in_use", metric="a.value_in_use"),
        check(616, "configurations WHERE name = 'max server memory (MB)' AND value_in_use = 2147483647", **cfg),
        check(617, names_differ, obj="server_name_var || ' ' || server_name_prop"),
        check(618, "drives WHERE CAST((total_mb - free_mb) * 100 / total_mb AS DECIMAL(5,2)) > 90.0", obj="drive", metric="CAST((total_mb - free_mb) * 100 / total_mb AS DECIMAL(5,2))"),
        check(620, "fdb f WHERE database_id <> 2 AND growth > 0 AND max_size NOT IN (0, -1) AND max_size < 268435456 AND dbname <> 'DB_Administration'", metric="max_size // 128", **fkw),
        check(621, "server_principals p JOIN instances i USING (instance_id) WHERE sid = '0x010100000000000512000000' AND edition ILIKE '%evaluation%'", obj=day("create_date + INTERVAL 180 DAY")),
        check(622, logs + " AND CAST(value AS INTEGER) <= 6" + sysadmin, metric="value"),
        *[check(623, f"databases WHERE {c}", db="name", case=n) for n, c in enumerate(("is_published", "is_subscribed", "is_merge_published", "is_distributor"))],
        check(624, "os_memory WHERE available_physical_kb < 1048576", metric="available_physical_kb // 1024"),
        check(625, "databases d JOIN databases s ON s.instance_id = d.instance_id AND s.database_id = d.source_database_id", iid="d.instance_id", db="d.name", obj=f"s.name || ' ' || {day('d.create_date')}"),
        check(626, "configurations WHERE value <> value_in_use AND NOT (name = 'min server memory (MB)' AND value IN (0, 16) AND value_in_use IN (0, 16))", obj="concat_ws(' ', name, value_in_use, value)"),
        check(627, "databases WHERE state NOT IN (0, 6)", db="name", obj="state_desc"),
        check(629, f"memory_dumps WHERE creation_time >= {NOW} - INTERVAL 90 DAY", obj=second("max(creation_time)"), metric="count(*)", group="instance_id"),
        check(630, "fdb f WHERE f.name = 'master' AND database_id > 4 AND dbname <> 'master'", **fkw), check(631, "configurations WHERE name = 'priority boost' AND (value = 1 OR value_in_use = 1)", obj="name"),
        check(632, "databases d JOIN inst i USING (instance_id) WHERE database_id <= 4 AND compatibility_level < CAST(split_part(product_version, '.', 1) AS INTEGER) * 10", db="d.name", metric="compatibility_level")]
    out["reliability_other"] = versions + [
        check(611, user_jobs, **job_owner), check(622, f"instances i LEFT JOIN (SELECT * FROM {logs}) r USING (instance_id) WHERE coalesce(CAST(r.value AS INTEGER), 12) <= 7", metric="coalesce(CAST(r.value AS INTEGER), 12)"),
        check(617, names_differ + grouped, obj="server_name_var || ' ' || server_name_prop"), agent]
    out["reliability_tempdb"] = [
        uptime, no_growth, check(604, "files f WHERE database_id = 2 AND physical_name ILIKE 'C:%' AND (SELECT count(DISTINCT left(x.physical_name, 1)) FROM files x WHERE x.instance_id = f.instance_id AND x.database_id = 2) > 1", **tkw),
        check(619, "files f JOIN instances i USING (instance_id) WHERE database_id = 2 AND growth > 0 AND max_size NOT IN (0, -1) AND (type = 0 OR (type = 1 AND max_size < CASE WHEN service_tier = 'GeneralPurpose' THEN 15597568 ELSE 268435456 END))",
              metric="max_size // 128", **tkw)]

    flag = "inst i WHERE {} AND NOT EXISTS (SELECT 1 FROM trace_flags t WHERE t.instance_id = i.instance_id AND t.trace_flag = '{}')"

    def flags(spared: str) -> list[str]:
        return [check(n, flag.format(f"major < 13{spared}", t), obj=f"'{t}'") for n, t in ((715, 1117), (716, 1118))]

    temp = "(SELECT instance_id, sum(CASE WHEN type = 0 THEN 1 ELSE 0 END) AS n, sum(CASE WHEN type = 1 THEN 1 ELSE 0 END) AS logs FROM files WHERE database_id = 2 GROUP BY instance_id) x JOIN inst i USING (instance_id)"
    per_temp = "(SELECT instance_id, {} AS bad FROM files WHERE database_id = 2 GROUP BY instance_id) x WHERE bad"
    tdb = dict(db="'tempdb'")
    layout = [check(708, per_temp.format("count(DISTINCT CASE WHEN type = 0 THEN size END) > 1"), **tdb),
              check(709, "(SELECT instance_id, data_space_id FROM files WHERE database_id = 2 AND type = 0 GROUP BY ALL HAVING count(DISTINCT (growth, is_percent_growth)) > 1) x", distinct=True, **tdb),
              check(710, per_temp.format("sum(CASE WHEN type = 1 THEN size END) > sum(CASE WHEN type = 0 THEN size END)"), **tdb), check(713, temp + " WHERE logs > 1", metric="logs", **tdb)]
    stall = "io_stats s JOIN files f USING (instance_id, database_id, file_id) WHERE database_id = 2 AND (num_of_reads > 0 OR num_of_writes > 0) AND trunc(io_stall_{0}_ms / nullif(num_of_{0}s, 0)) > 100"
    tempdb = layout + [
        check(711, "files f WHERE database_id = 2 AND is_percent_growth", **tkw), check(712, "files f WHERE database_id = 2 AND NOT is_percent_growth AND growth BETWEEN 1 AND 8191", metric="growth", **tkw),
        check(714, "files f WHERE database_id = 2 AND space_used / size * 100 > 50", **tkw),
        *[check(n, stall.format(k), metric=f"trunc(io_stall_{k}_ms / num_of_{k}s)", **tkw) for n, k in ((718, "read"), (719, "write"))],
        check(717, "configurations JOIN inst USING (instance_id) WHERE name = 'tempdb metadata memory-optimized' AND value_in_use = 1 AND major >= 15", **cfg)]

    def counted(spared: str) -> str:
        return check(707, temp + f" WHERE n <> CASE WHEN cpu_count < 8 THEN cpu_count ELSE 8 END{spared}", obj="cpu_count || ' cores'", metric="n", **tdb)

    rg = "rg_groups g JOIN rg_pools p USING (instance_id, pool_id) JOIN resource_governor r USING (instance_id) JOIN inst i USING (instance_id) WHERE is_enabled AND major >= 17 AND {0} IS NOT NULL"
    out["performance_tempdb"] = tempdb + flags(" AND NOT managed") + [
        counted(" AND NOT managed"), check(730, temp + " WHERE n > 16", metric="n", **tdb),
        *[check(727, rg.format(c), obj="group_name || ' ' || pool_name", metric=c, case=n, **tdb) for n, c in enumerate(("max_tempdb_mb", "max_tempdb_percent"))],
        check(741, "databases d JOIN inst i USING (instance_id) WHERE database_id = 2 AND is_accelerated_database_recovery_on AND major >= 17", db="d.name")]
    plan = "(SELECT instance_id, coalesce(max(CASE WHEN key = 'PolicyPowerScheme' THEN value END), max(CASE WHEN key = 'LocalPowerScheme' THEN value END)) AS plan FROM registry_settings WHERE key LIKE '%PowerScheme' GROUP BY instance_id) x"
    locked = "os_memory m LEFT JOIN configurations c ON c.instance_id = m.instance_id AND c.name = 'max server memory (MB)' WHERE locked_page_kb > 0"
    locked_text = dict(iid="m.instance_id", obj="CASE WHEN locked_page_kb >= 1048576 THEN (locked_page_kb // 1048576) || ' GB' ELSE (locked_page_kb // 1024) || ' MB' END", metric="locked_page_kb")
    frozen = "(SELECT instance_id, dbname, count(*) AS n, sum(ms) / count(*) AS average FROM pairs GROUP BY ALL) x"
    frozen_text = dict(db="dbname", obj="n || ' freezes'", metric="average")
    out["performance_health"] = tempdb + flags("") + [
        counted(""), check(701, "configurations WHERE name = 'cost threshold for parallelism' AND value_in_use = 5", **cfg),
        *[check(702, f"configurations WHERE name = 'max degree of parallelism' AND value_in_use = {n}", case=n, **cfg) for n in (0, 1)],
        *[check(n, f"online WHERE {w}", db="name") for n, w in ((703, "is_auto_shrink_on"), (704, "is_auto_close_on"), (728, "NOT is_auto_create_stats_on"), (734, "is_recursive_triggers_on"),
          (735, "is_parameterization_forced"), (736, "is_cdc_enabled"), (737, "delayed_durability <> 0"), (740, "NOT is_auto_update_stats_on"))],
        check(705, "online WHERE compatibility_level < major * 10", db="name", metric="compatibility_level"),
        *[check(706, flag.format(w, t), obj=f"'{t}'") for t, w in ((2371, "major < 13"), (7752, "major >= 13 AND major < 15"), (7745, "major >= 13"), (3226, "TRUE"))],
        check(720, "(SELECT instance_id, dbname, sum(CASE WHEN type = 1 THEN size END) AS log, sum(CASE WHEN type = 0 THEN size END) AS data FROM fdb WHERE database_id <> 2 AND dbname IS NOT NULL GROUP BY ALL) x WHERE log > data AND log > 12800",
              db="dbname", metric="log"),
        check(721, "fdb f WHERE database_id <> 2 AND is_percent_growth", **fkw), check(722, "fdb f WHERE database_id NOT IN (1, 2, 4) AND NOT is_percent_growth AND growth BETWEEN 1 AND 8191", metric="growth", **fkw),
        check(723, "(SELECT instance_id, database_id, dbname, count(*) AS n FROM fdb WHERE type_desc = 'LOG' AND database_id <> 2 GROUP BY ALL) x WHERE n > 1", db="dbname", metric="n"),
        check(724, f"{plan} WHERE plan <> '8c5e7fda-e8bf-4a96-9a85-a6e23a8c635c'" + sysadmin,
              obj="CASE plan WHEN 'a1841308-3541-4fab-bc81-f71556f20b4a' THEN 'power saving' WHEN '381b4222-f694-41f0-9685-ff5bb260df2e' THEN 'balanced power' ELSE 'an unknown power mode' END"),
        check(725, "svc s WHERE kind = 'engine' AND (instant_file_initialization_enabled = 'N' OR (instant_file_initialization_enabled IS NULL AND EXISTS (SELECT 1 FROM error_log g WHERE g.instance_id = s.instance_id) "
                   "AND NOT EXISTS (SELECT 1 FROM error_log g WHERE g.instance_id = s.instance_id AND message ILIKE 'Database Instant File Initialization: enabled%')))"),
        check(726, locked, **locked_text), check(742, locked + " AND value_in_use = 2147483647", **locked_text),
        check(729, "cpu_nodes d JOIN cpu_schedulers s ON s.instance_id = d.instance_id AND s.parent_node_id = d.node_id WHERE memory_node_id IS NOT NULL AND node_state_desc NOT LIKE '%DAC%' AND status = 'VISIBLE OFFLINE'",
              iid="d.instance_id", obj="'node ' || d.node_id", metric="count(*)", group="d.instance_id, d.node_id"),
        check(731, "resource_governor WHERE is_enabled"), check(732, "server_triggers WHERE NOT is_disabled AND NOT is_ms_shipped AND left(name, 4) <> 'rds_'", obj="name"),
        check(733, "change_tracking t JOIN databases d USING (instance_id, database_id)", db="d.name"),
        check(738, "xe_sessions WHERE name NOT IN ('AlwaysOn_health', 'system_health', 'telemetry_xevents', 'sp_server_diagnostics', 'sp_server_diagnostics session', 'hkenginexesession') AND name NOT LIKE '%$A%'", obj="name"),
        check(739, f"{frozen} WHERE TRUE" + sysadmin, **frozen_text)]
    out["performance_backup"] = [check(739, frozen, **frozen_text)]

    first = "(SELECT instance_id, message FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY log_date, message) AS rn FROM error_log WHERE message LIKE '%{}%') y WHERE rn = 1) x"
    maker = "System Manufacturer: ''(.*?)'', System Model: ''(.*?)''[.]"

    def facts(ids, scope: str = "") -> list[str]:
        rows = {
            100: ("inst", "'08/02/2001'"), 101: ("inst", "coalesce(machine_name, '')"), 102: ("inst", "coalesce(instance_name, '(default instance)')"), 103: (ver, "'SQL Server ' || vname"),
            104: ("inst", "edition"), 105: ("inst", "product_version"), 106: (first.format("Logging SQL Server messages in file") + " WHERE TRUE" + sysadmin, "replace(replace(message, 'Logging SQL Server messages in file ''', ''), '''.', '')"),
            107: ("inst", "data_path"), 108: ("inst", "log_path"), 109: ("inst", "backup_path"), 111: ("inst", "transport || CASE WHEN transport = 'TCP' THEN ' on port ' || tcp_port ELSE '' END"),
            112: ("inst", "strftime(start_time, '%Y-%m-%d %H:%M:%S.%g')"), 113: ("inst", "cpu_count || ' core(s) across ' || (cpu_count // hyperthread_ratio) || ' CPU socket(s)'"), 114: ("inst", "physical_memory_kb // 1024"),
            115: (first.format("Copyright"), "substr(message, strpos(message, 'Windows'))"), 116: ("svc WHERE kind = 'engine'", "service_account"), 117: ("svc WHERE kind = 'agent'", "service_account"),
            118: ("installed_instances WHERE TRUE" + sysadmin + " GROUP BY instance_id", "count(*)"), 119: ("inst", "coalesce(net_address, 'UNKNOWN')"),
            120: (first.format("System Manufacturer:"), f"regexp_extract(message, '{maker}', 1) || ': ' || regexp_extract(message, '{maker}', 2)"),
            198: ("rights", "can_connect"), 199: ("rights", "is_sysadmin")}
        return [f"SELECT * FROM ({check(i, rows[i][0], obj=rows[i][1])}) t{scope}" for i in ids]

    HELPERS["flagtext"] = ("SELECT instance_id, trace_flag || ': ' || CASE trace_flag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in discovery.FLAG_TEXTS.items())
                           + " ELSE 'Look up this trace flag.' END AS what FROM trace_flags")
    out["discovery_groups"] = facts(discovery.AG_IDS, " WHERE instance_id IN (SELECT instance_id FROM ginst)") + [check(110, "flagtext WHERE TRUE" + grouped + sysadmin, obj="what")]
    out["discovery_health"] = facts(discovery.HEALTH_IDS) + [check(110, "flagtext", obj="what")]
    out["discovery_security"] = facts(discovery.SECURITY_IDS)
    return out


# Derived by a shuffle over the largest tables and read by many checks.
HISTORY_TABLES = ("backup_sets", "backup_media")


def facts_of(t: Tables, params: AuditParams = PARAMS, stage: bool = False) -> Facts:
    return Facts(derived_fleet(t, HISTORY_TABLES if stage else ()), replace(params, stage_facts=stage))


_PLANS = {
    "recoverability_backup": recoverability.backup_profile, "recoverability_health": recoverability.health_profile, "recoverability_security": recoverability.security_profile,
    "security_logins": lambda f: [security.roles(f), security.server_permissions(f), security.sa_login(f), security.passwords(f), security.invalid_logins(f),
                                  security.local_administrators(f), security.services(f), security.proxies(f)],
    "security_settings": lambda f: [security.settings_on(f), security.settings_reported(f), security.registry_states(f), security.audit_level(f), security.failed_logins(f),
                                    security.linked_servers(f), security.startup_code(f), security.audits(f)],
    "security_databases": lambda f: [security.owners(f), security.owner_discrepancy(f), security.database_roles(f), security.orphaned_users(f), security.public_permissions(f),
                                     security.encryption(f), security.endpoint_owner(f), security.tempdb_encrypted(f)],
    "security_health": security.health_profile,
    "availability_databases": availability.health_profile, "availability_groups": availability.group_profile,
    "integrity_health": integrity.health_profile, "integrity_groups": integrity.group_profile,
    "reliability_health": reliability.health_profile, "reliability_tempdb": reliability.tempdb_profile,
    "reliability_other": lambda f: reliability.security_profile(f) + reliability.group_profile(f) + reliability.backup_profile(f),
    "performance_health": performance.health_profile, "performance_tempdb": performance.tempdb_profile, "performance_backup": performance.backup_profile,
    "discovery_groups": discovery.group_profile, "discovery_health": discovery.health_profile, "discovery_security": discovery.security_profile,
}

for _name, _plan in _PLANS.items():
    def _run(t: Tables, plan=_plan) -> DataFrame:
        return union(*plan(facts_of(t, stage=plan is recoverability.backup_profile)))

    _run.__doc__ = f"Checks: {_name.replace('_', ', ')}."
    query(f"checks_{_name}", with_tables(all_of(*_statements()[_name])))(_run)


# Statements that make up a whole profile, by group.
_PROFILE_GROUPS = {
    "ag": ["discovery_groups", "availability_groups", "integrity_groups"], "backup": ["recoverability_backup", "performance_backup"],
    "health": ["discovery_health", "recoverability_health", "security_health", "availability_databases", "integrity_health", "reliability_health", "performance_health"],
    "security": ["discovery_security", "recoverability_security", "security_logins", "security_settings", "security_databases"],
    "tempdb": ["reliability_tempdb", "performance_tempdb"],
}
# Checks a profile takes from a group it shares with others.
_EXTRA = {"ag": [617], "backup": [503, 628], "security": [601, 602, 611, 622], "tempdb": [356]}


# Importance by check: fixed values. All other checks have importance 2 (medium).
_INFORMATIONAL = (*range(100, 121), 198, 199)
_HIGH = (201, 203, 204, 205, 206, 207, 210, 211, 212, 214, 218, 301, 302, 303, 307, 308, 315, 316, 317, 318, 323, 329, 330, 331, 334, 336, 351, 353, 354,
         401, 402, 405, 406, 407, 408, 409, 410, 411, 413, 414, 417, 421, 429, 430, 431, 432, 501, 502, 503, 504, 601, 602, 604, 606, 618, 619, 621, 624,
         628, 629, 630, 631, 632, 707, 708, 709, 711, 712, 713, 714, 718, 719, 721, 722, 723, 724, 725, 729, 730)
_LOW = (304, 306, 337, 338, 356, 419, 425, 603)
# Where a profile weighs or files a check differently: (category, importance) as SQL on check and case.
_OTHERWISE = {"health": ("WHEN check_id = 305 THEN 2", "WHEN check_id = 305 THEN 3"),
              "security": ("", "WHEN check_id = 212 OR (check_id = 210 AND case_no = 1) THEN 2")}


def weighed(profile: str) -> str:
    """Columns category_id and importance of a finding in a profile, from the lists above."""
    category, importance = _OTHERWISE.get(profile, ("", ""))
    return (f"CAST(CASE {category} WHEN TRUE THEN check_id // 100 END AS INTEGER) AS category_id, CAST(CASE {importance} WHEN check_id IN {_INFORMATIONAL} THEN 0 "
            f"WHEN check_id IN {_HIGH} THEN 1 WHEN check_id IN {_LOW} THEN 3 ELSE 2 END AS INTEGER) AS importance")


def profile_statements(profile: str) -> list[str]:
    """The statements that make up a profile."""
    groups = _statements()
    parts = [s for g in _PROFILE_GROUPS[profile] for s in groups[g] if not (profile == "security" and " CAST(356 AS" in s)]
    pool = groups["reliability_other"] + groups["integrity_health"] + groups["security_databases"]
    return parts + [next(s for s in pool if f" CAST({i} AS" in s) for i in _EXTRA.get(profile, [])]


def _profile_sql(profile: str) -> str:
    return (f"SELECT check_id, category_id, importance, count(*) AS findings, count(DISTINCT instance_id) AS instances FROM "
            f"(SELECT *, {weighed(profile)} FROM ({all_of(*profile_statements(profile))}) f) w GROUP BY check_id, category_id, importance")


for _profile in _PROFILE_GROUPS:
    def _summary(t: Tables, profile=_profile) -> DataFrame:
        # Counted by instance where they are found: a profile has many parts, and an instance many findings.
        found = staged_union([df.groupBy("check_id", "case_no", "instance_id").agg(F.count(F.lit(1)).alias("n")) for df in findings_of(profile, facts_of(t, stage=True))], "counts")
        dim = F.broadcast(rule_dimension(t.spark, rules_for(profile)))
        return (found.join(dim, ["check_id", "case_no"]).groupBy("check_id", "category_id", "importance")
                .agg(F.sum("n").alias("findings"), F.countDistinct("instance_id").alias("instances")))

    _summary.__doc__ = f"Findings and instances per check of the whole {_profile} profile."
    query(f"profile_{_profile}", with_tables(_profile_sql(_profile)))(_summary)


# Where checks apply and what they need: fixed conditions, stated apart from the plans.
_GROUP_ONLY = (198, 199, 407, 412, 413, 414, 415, 416, 417, 418, 419, 421, 422, 423, 424, 425, 426, 427, 428, 429, 430, 431, 432, 504, 506)
_RIGHTS = (106, 118, 304, 420, 502, 505, 609, 610, 611, 622, 724)
_APPLIES = f"""CASE WHEN check_id IN {_GROUP_ONLY} AND NOT grouped THEN FALSE WHEN check_id IN (418, 423) THEN major >= 13 WHEN check_id = 202 THEN major > 11
    WHEN check_id = 215 THEN major < 11 WHEN check_id = 344 THEN major >= 11 WHEN check_id IN (210, 212) THEN major >= 12 WHEN check_id = 217 THEN major >= 13
    WHEN check_id IN (715, 716) THEN major < 13 WHEN check_id = 717 THEN major >= 15 WHEN check_id IN (727, 741) THEN major >= 17
    WHEN check_id IN (601, 602) THEN NOT managed AND major IN (SELECT num FROM vnames) WHEN check_id = 502 THEN engine_edition IN (2, 3, 8) ELSE TRUE END"""
_ASSESSMENT = f"""
SELECT i.instance_id, i.check_id, CAST(i.check_id // 100 AS SMALLINT) AS category_id,
  CASE WHEN f.check_id IS NOT NULL AND i.check_id >= 200 THEN 'failed' WHEN f.check_id IS NOT NULL THEN 'passed' WHEN NOT applies THEN 'not applicable'
       WHEN NOT collected_as_sysadmin AND (i.check_id IN {_RIGHTS} OR (i.check_id BETWEEN 301 AND 355 AND i.check_id NOT IN (305, 306, 307, 310))) THEN 'not assessed'
       WHEN i.check_id < 200 THEN 'not assessed' ELSE 'passed' END AS status
FROM (SELECT *, {_APPLIES} AS applies FROM (SELECT *, instance_id IN (SELECT instance_id FROM ginst) AS grouped,
        CAST(unnest(range(100, 121) || [198, 199] || range(201, 219) || range(301, 357) || range(401, 433) || range(501, 507) || range(601, 633) || range(701, 743)) AS INTEGER) AS check_id
      FROM inst) x) i
LEFT JOIN (SELECT DISTINCT instance_id, check_id FROM ({all_of(*[s for p in _PROFILE_GROUPS for s in profile_statements(p)])}) y) f ON f.instance_id = i.instance_id AND f.check_id = i.check_id
"""


@query("report_assessment", with_tables(_ASSESSMENT))
def report_assessment(t: Tables) -> DataFrame:
    """Every check on every instance: failed, passed, not applicable or not assessed."""
    return assess(facts_of(t, stage=True))
