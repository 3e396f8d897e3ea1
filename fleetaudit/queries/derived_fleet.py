"""A fleet derived from the given tables, so that the audit profiles run on data that grows with them.

A customer is an instance, an order a database, a line of an order a backup set, an event a log
line. The same SQL text serves Spark and the comparison engine; three marks differ between them:
``NTZ '...'`` is a zone-free time literal, ``EACH(a,b)`` makes one row per listed number, and
``{name}`` is a table.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..sources import Fleet
from .registry import Tables

AS_OF = "2001-08-02 12:00:00"
# Days from the events' month back to the fleet's month.
_SHIFT = "INTERVAL '8216' DAY"

_IID = "'I' || CAST(c_custkey AS STRING) AS instance_id"
_DB = "CASE WHEN o_orderkey % 499 = 5 THEN 'SSISDB' WHEN o_orderkey % 3 = 0 THEN 'DB_' || CAST(o_orderkey AS STRING) ELSE 'db_' || CAST(o_orderkey AS STRING) END"

SQL: dict[str, str] = {}

SQL["instances"] = f"""
SELECT {_IID}, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'HOST' || CAST(c_custkey % 400 AS STRING) END AS machine_name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'INST' || CAST(c_custkey AS STRING) END AS instance_name,
  CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 'SRV' || CAST(c_custkey AS STRING) END AS server_name_var,
  CASE WHEN c_custkey % 13 = 0 THEN 'OLD' ELSE 'SRV' END || CAST(c_custkey AS STRING) AS server_name_prop,
  CASE c_custkey % 6 WHEN 0 THEN 'Enterprise Edition (64-bit)' WHEN 1 THEN 'Standard Edition (64-bit)' WHEN 2 THEN 'Express Edition (64-bit)'
    WHEN 3 THEN 'Enterprise Evaluation Edition (64-bit)' WHEN 4 THEN 'Developer Edition (64-bit)' ELSE 'SQL Azure' END AS edition,
  CASE c_custkey % 6 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 5 THEN 8 ELSE 3 END AS engine_edition,
  CAST(10 + c_nationkey % 8 AS STRING) || CASE WHEN c_nationkey % 8 = 0 AND c_custkey % 2 = 0 THEN '.50.' ELSE '.0.' END
    || CAST(2000 + (c_custkey * 37) % 6000 AS STRING) || '.' || CAST(c_custkey % 9 AS STRING) AS product_version,
  CASE WHEN c_custkey % 6 = 1 THEN 'C:' ELSE 'D:' END || chr(92) || 'Data' AS data_path,
  CASE WHEN c_custkey % 5 = 0 THEN 'C:' ELSE 'L:' END || chr(92) || 'Log' AS log_path,
  CASE WHEN c_custkey % 7 = 0 THEN 'C:' || chr(92) || 'Backup' WHEN c_custkey % 31 = 0 THEN NULL ELSE 'S:' || chr(92) || 'Backup' END AS backup_path,
  CAST(2 + (c_custkey % 8) * 2 AS INTEGER) AS cpu_count, CAST(2 + (c_custkey % 2) * 2 AS INTEGER) AS hyperthread_ratio,
  CAST(4194304 + c_custkey * 1024 AS BIGINT) AS physical_memory_kb,
  NTZ '2000-06-01 03:04:05' + CAST(c_custkey % 400 AS INTEGER) * INTERVAL '1' DAY AS start_time,
  CAST((c_custkey % 5) * 90 - 120 AS INTEGER) AS utc_offset_minutes,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE '10.0.' || CAST(c_custkey % 250 AS STRING) || '.7' END AS net_address,
  CASE WHEN c_custkey % 4 = 1 THEN 'Shared memory' ELSE 'TCP' END AS transport, CAST(1433 + c_custkey % 3 AS INTEGER) AS tcp_port,
  c_custkey % 9 <> 0 AS collected_as_sysadmin, CASE WHEN c_custkey % 12 = 5 THEN 'GeneralPurpose' END AS service_tier,
  'CL' || CAST(c_custkey AS STRING) AS cluster_name, 'NODE_AND_FILE_SHARE_MAJORITY' AS quorum_type,
  CASE WHEN c_custkey % 6 = 0 THEN 'FORCED_QUORUM' ELSE 'NORMAL_QUORUM' END AS quorum_state,
  CASE c_custkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS can_connect_endpoint, CAST(c_custkey * 1500000 AS BIGINT) AS log_space_used_bytes
FROM {{customer}}"""

SQL["databases"] = f"""
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, CAST(5 + o_orderkey AS BIGINT) AS database_id, {_DB} AS name,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '0xFFFF' ELSE '0x0' || CAST(1 + o_orderkey % 8 AS STRING) END AS owner_sid,
  CASE o_orderkey % 23 WHEN 1 THEN 1 WHEN 2 THEN 6 WHEN 3 THEN 4 WHEN 4 THEN 10 ELSE 0 END AS state,
  CASE o_orderkey % 23 WHEN 1 THEN 'RESTORING' WHEN 2 THEN 'OFFLINE' WHEN 3 THEN 'SUSPECT' WHEN 4 THEN 'OFFLINE_SECONDARY' ELSE 'ONLINE' END AS state_desc,
  CASE o_orderstatus WHEN 'F' THEN 'FULL' WHEN 'O' THEN 'SIMPLE' ELSE 'BULK_LOGGED' END AS recovery_model_desc,
  CASE o_orderkey % 31 WHEN 0 THEN 'SINGLE_USER' WHEN 1 THEN 'RESTRICTED_USER' ELSE 'MULTI_USER' END AS user_access_desc,
  CASE o_orderkey % 19 WHEN 0 THEN 'NONE' WHEN 1 THEN 'TORN_PAGE_DETECTION' ELSE 'CHECKSUM' END AS page_verify_option_desc,
  CAST(80 + 10 * (o_orderkey % 10) AS INTEGER) AS compatibility_level, o_orderdate AS create_date,
  CASE WHEN o_orderkey % 17 = 0 THEN CAST(1 + o_orderkey % 4 AS BIGINT) END AS source_database_id,
  o_orderkey % 37 = 0 AS is_in_standby, o_orderkey % 13 = 0 AS is_read_only, o_orderkey % 29 = 0 AS is_encrypted,
  o_orderkey % 6 = 0 AS is_trustworthy_on, o_orderkey % 11 = 0 AS is_auto_shrink_on,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderkey % 14 = 0 END AS is_auto_close_on,
  o_orderkey % 15 <> 0 AS is_auto_create_stats_on, o_orderkey % 16 <> 0 AS is_auto_update_stats_on,
  o_orderkey % 18 = 0 AS is_recursive_triggers_on, o_orderkey % 20 = 0 AS is_parameterization_forced, o_orderkey % 21 = 0 AS is_cdc_enabled,
  o_orderkey % 33 = 0 AS is_published, o_orderkey % 22 = 0 AS is_subscribed, o_orderkey % 35 = 0 AS is_merge_published, o_orderkey % 36 = 0 AS is_distributor,
  o_orderkey % 5 = 0 AS is_accelerated_database_recovery_on, CASE o_orderkey % 22 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS delayed_durability,
  CASE WHEN o_orderkey % 24 = 0 THEN 1 ELSE 0 END AS containment, CASE WHEN o_orderkey % 13 = 0 THEN 'READ_ONLY' ELSE 'READ_WRITE' END AS updateability
FROM {{orders}}
UNION ALL
SELECT instance_id, CAST(n AS BIGINT), CASE n WHEN 1 THEN 'master' WHEN 2 THEN 'tempdb' WHEN 3 THEN 'model' ELSE 'msdb' END,
  CASE WHEN k % 6 = 0 AND n > 2 THEN '0x03' ELSE '0x01' END, 0, 'ONLINE', CASE WHEN n = 3 THEN 'FULL' ELSE 'SIMPLE' END,
  CASE WHEN k % 50 = 0 AND n = 4 THEN 'RESTRICTED_USER' ELSE 'MULTI_USER' END, CASE WHEN n = 2 THEN 'NONE' ELSE 'CHECKSUM' END,
  CAST(100 + 10 * (k % 8) AS INTEGER), NTZ '2000-06-01 00:00:00' + CAST(k % 420 AS INTEGER) * INTERVAL '1' DAY, CAST(NULL AS BIGINT),
  FALSE, FALSE, n = 2 AND k % 10 = 0, n = 4, FALSE, FALSE, TRUE, TRUE, FALSE, FALSE, FALSE, FALSE, FALSE, FALSE, FALSE, n = 2 AND k % 3 = 0, 0, 0, 'READ_WRITE'
FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3,4) AS n FROM {{customer}}) s"""

SQL["ag_membership"] = """
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, CASE WHEN o_orderkey % 4 = 1 THEN 'dB_' ELSE 'left_' END || CAST(o_orderkey AS STRING) AS database_name,
  'g' || CAST(o_custkey AS STRING) || '_' || CAST(o_orderkey % 2 AS STRING) AS group_id, 'AG' || CAST(o_orderkey % 2 AS STRING) AS group_name,
  CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_preferred_backup_replica
FROM {orders}"""

_SETS = """(SELECT l_orderkey, l_linenumber, max(l_shipdate) AS ship, max(l_quantity) AS qty, max(l_discount) AS disc, max(l_extendedprice) AS price,
  max(l_suppkey) AS supp, max(l_partkey) AS part, count(*) AS files FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""

SQL["backup_sets"] = f"""
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, l_orderkey * 10 + l_linenumber AS backup_set_id,
  CASE WHEN l_orderkey % 43 = 0 THEN NULL WHEN l_orderkey % 47 = 0 THEN 'ELSEWHERE' WHEN o_custkey % 13 = 0 THEN 'OLD' || CAST(o_custkey AS STRING)
    ELSE 'SRV' || CAST(o_custkey AS STRING) END AS server_name,
  'db_' || CAST(l_orderkey AS STRING) AS database_name,
  CASE WHEN l_linenumber IN (1, 4, 7) THEN 'D' WHEN l_linenumber IN (2, 5) THEN 'L' ELSE 'I' END AS type,
  CASE o_orderstatus WHEN 'F' THEN 'FULL' WHEN 'O' THEN 'SIMPLE' ELSE 'BULK-LOGGED' END AS recovery_model,
  CASE WHEN l_orderkey % 59 = 0 THEN NULL ELSE qty > 45 END AS is_copy_only, l_orderkey % 32 = 0 AS is_snapshot, l_orderkey % 27 = 0 AS is_password_protected,
  disc > 0.03 AS has_backup_checksums, CASE WHEN l_orderkey % 9 = 0 THEN 'CERTIFICATE' END AS encryptor_type,
  CASE WHEN l_orderkey % 9 = 0 THEN 'T' || CAST(l_orderkey % 4 AS STRING) END AS encryptor_thumbprint,
  ship + CAST(l_orderkey % 1440 AS INTEGER) * INTERVAL '1' MINUTE AS backup_start_date,
  CASE WHEN l_orderkey % 61 <> 0 THEN ship + CAST(l_orderkey % 1440 + l_linenumber * 7 AS INTEGER) * INTERVAL '1' MINUTE END AS backup_finish_date,
  CAST(CAST(floor(price) AS BIGINT) * 4096 AS DECIMAL(20,0)) AS backup_size,
  CAST(CAST(floor(price) AS BIGINT) * 4096 - CAST(floor(qty) AS BIGINT) * 1000 AS DECIMAL(20,0)) AS compressed_backup_size,
  l_orderkey * 10 + l_linenumber AS media_set_id, 'user' || CAST(supp % 5 AS STRING) AS user_name
FROM {_SETS} b INNER JOIN {{orders}} o ON o_orderkey = l_orderkey WHERE ship <= NTZ '2001-08-02 00:00:00'"""

# A set has one file, or two where its lines name two parts; aggregates only, as an order may be large.
SQL["backup_media"] = """
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, l_orderkey * 10 + l_linenumber AS media_set_id, CAST(n AS INTEGER) AS family_sequence_number,
  CASE part % 8 WHEN 0 THEN 'NUL' WHEN 1 THEN '{{A1B2-' || CAST(supp AS STRING) || '}}' WHEN 2 THEN '/mnt/backup' || CAST(supp % 3 AS STRING) || '/f' || CAST(part AS STRING)
    WHEN 3 THEN ' nul: ' WHEN 4 THEN 'plain' || CAST(part AS STRING)
    ELSE 'S:' || chr(92) || 'bak' || CAST(supp % 2 AS STRING) || chr(92) || 'f' || CAST(part AS STRING) || '.bak' END AS physical_device_name,
  CASE WHEN part % 6 = 0 THEN 'dev' || CAST(supp AS STRING) END AS logical_device_name,
  CASE part % 7 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 9 WHEN 4 THEN 105 WHEN 5 THEN 3 ELSE 2 END AS device_type
FROM (SELECT l_orderkey, l_linenumber, n, CASE WHEN n = 1 THEN part_lo ELSE part_hi END AS part, CASE WHEN n = 1 THEN supp_lo ELSE supp_hi END AS supp
      FROM (SELECT l_orderkey, l_linenumber, part_lo, part_hi, supp_lo, supp_hi, EACH(1,2) AS n
            FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part_lo, max(l_partkey) AS part_hi, min(l_suppkey) AS supp_lo, max(l_suppkey) AS supp_hi
                  FROM {lineitem} GROUP BY l_orderkey, l_linenumber) a) b WHERE n = 1 OR part_hi <> part_lo) m
INNER JOIN {orders} o ON o_orderkey = l_orderkey"""

SQL["restore_history"] = f"""
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, CASE WHEN o_orderkey % 3 = 1 THEN 'dropped_' ELSE '' END || {_DB} AS destination_database_name,
  o_orderdate + CAST(n * (30 + o_orderkey % 9) AS INTEGER) * INTERVAL '1' DAY AS restore_date, 'restorer' || CAST(n AS STRING) AS user_name,
  CASE (o_orderkey + n) % 8 WHEN 0 THEN 'D' WHEN 1 THEN 'F' WHEN 2 THEN 'G' WHEN 3 THEN 'I' WHEN 4 THEN 'L' WHEN 5 THEN 'V' WHEN 6 THEN 'R' END AS restore_type,
  CASE (o_orderkey + n) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS replace, CASE (o_orderkey + n) % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS recovery,
  CASE WHEN n = 2 THEN o_orderdate END AS stop_at
FROM (SELECT o_custkey, o_orderkey, o_orderdate, EACH(1,2,3) AS n FROM {{orders}}) s"""

# Names of instance settings with the values the derived fleet gives them.
_SETTINGS = [
    ("backup compression default", "k % 2"), ("backup checksum default", "k % 3"), ("backup compression", "k % 4"), ("backup checksum", "k % 5"),
    ("clr enabled", "k % 2"), ("remote admin connections", "k % 2"), ("Database Mail XPs", "k % 3"), ("xp_cmdshell", "k % 4"),
    ("Ole Automation Procedures", "k % 5"), ("cross db ownership chaining", "k % 6"), ("Ad Hoc Distributed Queries", "k % 7"),
    ("c2 audit mode", "k % 2"), ("common criteria compliance enabled", "k % 3"), ("contained database authentication", "k % 2"),
    ("remote access", "k % 2"), ("min server memory (MB)", "CASE WHEN k % 9 = 0 THEN 2147483647 WHEN k % 5 = 0 THEN 16 ELSE 1024 END"),
    ("max server memory (MB)", "CASE WHEN k % 3 = 0 THEN 2147483647 WHEN k % 7 = 0 THEN 1024 ELSE 65536 END"),
    ("priority boost", "k % 8"), ("cost threshold for parallelism", "5 * (1 + k % 3)"), ("max degree of parallelism", "k % 5"),
    ("tempdb metadata memory-optimized", "k % 2"),
]

SQL["configurations"] = f"""
SELECT instance_id, CASE n {' '.join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(_SETTINGS))} END AS name,
  CASE WHEN (k + n) % 10 = 0 THEN CAST(CASE n {' '.join(f"WHEN {i} THEN {e}" for i, (_, e) in enumerate(_SETTINGS))} END AS BIGINT) + 1
       WHEN n = 15 AND k % 5 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(CASE n {' '.join(f"WHEN {i} THEN {e}" for i, (_, e) in enumerate(_SETTINGS))} END AS BIGINT) END AS value,
  CAST(CASE n {' '.join(f"WHEN {i} THEN {e}" for i, (_, e) in enumerate(_SETTINGS))} END AS BIGINT) AS value_in_use
FROM (SELECT {_IID}, c_custkey AS k, EACH({','.join(str(i) for i in range(len(_SETTINGS)))}) AS n FROM {{customer}}) s"""

SQL["registry_settings"] = f"""
SELECT instance_id, CASE n WHEN 1 THEN 'AuditLevel' WHEN 2 THEN 'NumErrorLogs' WHEN 3 THEN 'HideInstance' WHEN 4 THEN 'ExtendedProtection'
    WHEN 5 THEN 'ForceEncryption' WHEN 6 THEN 'PolicyPowerScheme' ELSE 'LocalPowerScheme' END AS key,
  CASE n WHEN 1 THEN CAST(k % 4 AS STRING) WHEN 2 THEN CAST(4 + k % 6 AS STRING) WHEN 3 THEN CAST(k % 2 AS STRING) WHEN 4 THEN CAST(k % 3 AS STRING)
    WHEN 5 THEN CAST((k + 1) % 2 AS STRING)
    ELSE CASE (k + n) % 4 WHEN 0 THEN '8c5e7fda-e8bf-4a96-9a85-a6e23a8c635c' WHEN 1 THEN 'a1841308-3541-4fab-bc81-f71556f20b4a'
      WHEN 2 THEN '381b4222-f694-41f0-9685-ff5bb260df2e' ELSE '00000000-aaaa' END END AS value
FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3,4,5,6,7) AS n FROM {{customer}}) s WHERE NOT (n = 6 AND k % 3 <> 0) AND (k * 3 + n) % 11 <> 0"""

SQL["error_log"] = f"""
SELECT 'I' || CAST(user_id AS STRING) AS instance_id, ts - {_SHIFT} AS log_date, 'spid' || CAST(event_id % 60 AS STRING) AS process_info,
  CASE event_type WHEN 'error' THEN 'I/O is frozen on database db.' || CAST(event_id % 2 AS STRING) || '. No user action is required. However, you could cancel the backup.'
    WHEN 'purchase' THEN 'I/O was resumed on database db.' || CAST(event_id % 2 AS STRING) || '. No user action is required.'
    WHEN 'click' THEN CASE WHEN user_id % 3 = 0 THEN 'Starting up database.' ELSE 'Login failed for user ''u' || CAST(event_id % 9 AS STRING) || '''.' END
    WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'Logging SQL Server messages in file ''C:' || chr(92) || 'Log' || CAST(user_id AS STRING) || chr(92) || 'ERRORLOG''.'
      WHEN 1 THEN 'Microsoft SQL Server - Copyright (C) Microsoft Corporation Edition (64-bit) on Windows Server 20' || CAST(10 + user_id % 10 AS STRING) || ' (Build 1)'
      WHEN 2 THEN 'System Manufacturer: ''Maker ' || CAST(user_id % 4 AS STRING) || ''', System Model: ''Model ' || CAST(user_id % 7 AS STRING) || '''.'
      ELSE 'Database Instant File Initialization: enabled. For security and performance considerations see the topic.' END
    ELSE CASE event_id % 4 WHEN 0 THEN 'BACKUP failed to complete the command BACKUP DATABASE [db_' || CAST(event_id % 50 AS STRING) || ']. Check the log.'
      WHEN 1 THEN 'BACKUP failed to complete the command BACKUP LOG db_' || CAST(event_id % 50 AS STRING) || '. Check the log.'
      WHEN 2 THEN 'BACKUP failed to complete the command BACKUP CERTIFICATE x. Check the log.' ELSE 'This is an informational message only.' END END AS message
FROM {{events}}"""

SQL["db_info"] = f"""
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, {_DB} AS database_name, CASE n WHEN 1 THEN 'dbi_dbccLastKnownGood' WHEN 2 THEN 'dbi_dbccLastKnownGood' ELSE 'dbi_crdate' END AS field,
  CASE WHEN o_orderkey % 40 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN '1900-01-01 00:00:00' ELSE CAST(o_orderdate + CAST(60 AS INTEGER) * INTERVAL '1' DAY AS STRING) END AS value
FROM (SELECT o_custkey, o_orderkey, o_orderdate, EACH(1,2,3) AS n FROM {{orders}}) s"""

SQL["files"] = """
SELECT instance_id, database_id, CAST(n AS INTEGER) AS file_id, CASE WHEN n = 2 OR n = 4 THEN 1 ELSE 0 END AS type,
  CASE WHEN n = 2 OR n = 4 THEN 'LOG' ELSE 'ROWS' END AS type_desc, CASE WHEN database_id % 83 = 0 AND n = 1 THEN 'master' ELSE 'f' || CAST(database_id AS STRING) || '_' || CAST(n AS STRING) END AS name,
  CASE (database_id + n * n) % 5 WHEN 0 THEN 'C:' WHEN 1 THEN 'D:' WHEN 2 THEN 'E:' WHEN 3 THEN 'D:' ELSE 'L:' END || chr(92) || 'sql' || chr(92) || 'f' || CAST(n AS STRING) AS physical_name,
  CAST(1024 AS BIGINT) * (1 + (database_id + n) % 9) AS initial_size, CAST(1024 AS BIGINT) * (1 + (database_id * n) % 40) AS size,
  CASE (database_id + n) % 6 WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN CAST(268435456 AS BIGINT) WHEN 2 THEN CAST(500000 AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS max_size,
  CASE (database_id + n) % 7 WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN CAST(10 AS BIGINT) WHEN 2 THEN CAST(8191 AS BIGINT) ELSE CAST(8192 AS BIGINT) END AS growth,
  CASE WHEN database_id % 71 = 0 THEN NULL ELSE CAST(100 AS BIGINT) * ((database_id + n * 13) % 300) END AS space_used, (database_id + n) % 7 = 1 AS is_percent_growth,
  CASE WHEN n = 2 OR n = 4 THEN 0 ELSE 1 END AS data_space_id, CASE WHEN n = 2 OR n = 4 THEN NULL ELSE 'PRIMARY' END AS filegroup
FROM (SELECT instance_id, database_id, EACH(1,2,3,4) AS n FROM {databases} WHERE database_id <> 2) s
WHERE n <= 2 OR (n = 3 AND database_id % 4 = 0) OR (n = 4 AND database_id % 9 = 0)
UNION ALL
SELECT instance_id, CAST(2 AS BIGINT), CAST(n AS INTEGER), CASE WHEN n = 2 OR n = 20 THEN 1 ELSE 0 END, CASE WHEN n = 2 OR n = 20 THEN 'LOG' ELSE 'ROWS' END, 'tempdev' || CAST(n AS STRING),
  CASE WHEN k % 6 = 0 THEN 'C:' WHEN k % 6 = 1 AND n = 3 THEN 'C:' ELSE 'T:' END || chr(92) || 'tempdb' || CAST(n AS STRING) || '.ndf',
  CAST(1024 AS BIGINT), CASE WHEN n = 2 THEN CAST(1024 AS BIGINT) * (4 + k % 90) WHEN k % 8 = 0 AND n = 3 THEN CAST(4096 AS BIGINT) ELSE CAST(2048 AS BIGINT) END,
  CASE WHEN (k + n) % 10 = 0 THEN CAST(20000000 AS BIGINT) WHEN (k + n) % 10 = 1 THEN CAST(0 AS BIGINT) ELSE CAST(-1 AS BIGINT) END,
  CASE (k + n) % 13 WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN CAST(4096 AS BIGINT) ELSE CAST(8192 AS BIGINT) END, CAST(16 AS BIGINT) * ((k + n) % 128), k % 15 = 0 AND n = 1,
  CASE WHEN n = 2 OR n = 20 THEN 0 ELSE 1 END, CASE WHEN n = 2 OR n = 20 THEN NULL ELSE 'PRIMARY' END
FROM (SELECT 'I' || CAST(c_custkey AS STRING) AS instance_id, c_custkey AS k, EACH(1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20) AS n FROM {customer}) t WHERE n <= 2 + k % 19"""

SQL["io_stats"] = """
SELECT instance_id, database_id, file_id, CASE WHEN size % 3 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(100 + file_id AS BIGINT) END AS num_of_reads, CAST(file_id % 4 AS BIGINT) AS num_of_writes,
  space_used * 10 AS io_stall_read_ms, space_used AS io_stall_write_ms FROM {files}"""

SQL["drives"] = f"""
SELECT instance_id, CASE n WHEN 1 THEN 'C' WHEN 2 THEN 'D' WHEN 3 THEN 'E' ELSE 'L' END AS drive, CASE WHEN (k + n) % 4 = 0 THEN NULL ELSE 'vol' || CAST(n AS STRING) END AS volume,
  CAST(1000 * (1 + k % 50) AS DECIMAL(18,0)) AS total_mb, CAST(floor(1000 * (1 + k % 50) * ((k + n * 7) % 25) / 100) AS DECIMAL(18,0)) AS free_mb
FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3,4) AS n FROM {{customer}}) s WHERE n <= 1 + k % 4"""

SQL["certificates"] = f"""
SELECT instance_id, 'cert' || CAST(n AS STRING) AS name, 'T' || CAST(n AS STRING) AS thumbprint,
  CASE (k + n) % 3 WHEN 0 THEN NULL WHEN 1 THEN NTZ '2001-05-04 12:00:00' ELSE NTZ '2001-05-04 12:00:01' END AS pvt_key_last_backup_date,
  NTZ '2002-01-01 00:00:00' + CAST(k % 300 AS INTEGER) * INTERVAL '1' DAY AS expiry_date
FROM (SELECT {_IID}, c_custkey AS k, EACH(0,1,2,3) AS n FROM {{customer}}) s"""

SQL["encryption_keys"] = """
SELECT instance_id, database_id, 'T' || CAST(database_id % 4 AS STRING) AS encryptor_thumbprint, CASE WHEN database_id % 2 = 0 THEN 'AES' ELSE 'TRIPLE_DES' END AS key_algorithm,
  CAST(128 + 64 * (database_id % 3) AS INTEGER) AS key_length FROM {databases} WHERE is_encrypted"""

SQL["db_log_stats"] = "SELECT instance_id, database_id, database_id % 402 AS total_vlf_count FROM {databases}"

SQL["server_services"] = f"""
SELECT instance_id, CASE n WHEN 1 THEN 'SQL Server (MSSQLSERVER)' ELSE 'SQL Server Agent (MSSQLSERVER)' END AS servicename,
  CASE (k + n) % 6 WHEN 0 THEN 'LocalSystem' WHEN 1 THEN 'NT Authority' || chr(92) || 'System' WHEN 2 THEN 'CORP' || chr(92) || 'user3' WHEN 3 THEN 'login2' ELSE 'CORP' || chr(92) || 'svc' END AS service_account,
  CASE WHEN (k + n) % 7 = 0 THEN 'Stopped' ELSE 'Running' END AS status_desc, CASE WHEN k % 2 = 0 THEN 'Automatic' ELSE 'Manual' END AS startup_type_desc,
  CASE WHEN n = 2 OR k % 4 = 3 THEN NULL WHEN k % 4 = 0 THEN 'N' ELSE 'Y' END AS instant_file_initialization_enabled
FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2) AS n FROM {{customer}}) s"""

SQL["trace_flags"] = f"""
SELECT instance_id, CASE n WHEN 1 THEN '1117' WHEN 2 THEN '1118' WHEN 3 THEN '2371' WHEN 4 THEN '3226' WHEN 5 THEN '7745' WHEN 6 THEN '7752' WHEN 7 THEN '9567' WHEN 8 THEN '1800' ELSE '4199' END AS trace_flag,
  TRUE AS status, TRUE AS is_global, FALSE AS is_session FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3,4,5,6,7,8,9) AS n FROM {{customer}}) s WHERE (k * 7 + n * 5) % 11 < 4"""

_PRINCIPAL = ("CASE n WHEN 1 THEN CASE WHEN k % 10 = 0 THEN 'admin' ELSE 'sa' END WHEN 2 THEN 'login2' WHEN 3 THEN 'CORP' || chr(92) || 'user3' WHEN 4 THEN 'NT SERVICE' || chr(92) || 'MSSQLSERVER' "
              "WHEN 5 THEN '##MS_Policy##' WHEN 6 THEN 'l_certSignSmDetach' WHEN 7 THEN 'CORP' || chr(92) || 'group7' WHEN 8 THEN 'app8' ELSE 'NT AUTHORITY' || chr(92) || 'SYSTEM' END")
_SIDS = "CASE n WHEN 9 THEN '0x010100000000000512000000' ELSE '0x0' || CAST(n AS STRING) END"

SQL["server_principals"] = f"""
SELECT instance_id, CAST(n AS BIGINT) AS principal_id, {_PRINCIPAL} AS name, {_SIDS} AS sid, CASE WHEN n IN (3, 4, 9) THEN 'U' WHEN n = 7 THEN 'G' WHEN n = 6 THEN 'C' ELSE 'S' END AS type,
  CASE WHEN n = 1 THEN k % 4 = 0 ELSE k % 20 = 0 END AS is_disabled, (k + n) % 9 = 0 AS deny_login, NTZ '2001-01-01 00:00:00' + CAST(k % 200 AS INTEGER) * INTERVAL '1' DAY AS create_date
FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3,4,5,6,7,8,9) AS n FROM {{customer}}) s"""

SQL["sql_logins"] = """
SELECT instance_id, principal_id, name, sid, is_disabled, 'x' || instance_id || CAST(principal_id AS STRING) AS salt,
  HASH256('x' || instance_id || CAST(principal_id AS STRING) || CASE (length(instance_id) + principal_id) % 5 WHEN 0 THEN '' WHEN 1 THEN name WHEN 2 THEN 'password' ELSE 'Str0ng' END) AS digest
FROM {server_principals} WHERE type = 'S'"""

SQL["server_role_members"] = f"""
SELECT instance_id, CASE WHEN n < 100 THEN 'sysadmin' ELSE 'securityadmin' END AS role_name, {_PRINCIPAL.replace('CASE n ', 'CASE n % 100 ')} AS member_name
FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3,4,5,6,7,9,101,102,103,108) AS n FROM {{customer}}) s WHERE n = 1 OR (k * 3 + n) % 4 <> 0"""

SQL["server_permissions"] = f"""
SELECT instance_id, CAST(n % 100 AS BIGINT) AS grantee_principal_id, CASE WHEN n >= 300 THEN 105 ELSE 100 END AS class, CASE WHEN n >= 300 THEN CAST(7 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS major_id,
  CASE WHEN n < 100 THEN 'CL' WHEN n < 200 THEN 'IAL' WHEN n < 300 THEN 'ALLG' ELSE 'CO' END AS type,
  CASE WHEN n < 100 THEN 'CONTROL SERVER' WHEN n < 200 THEN 'IMPERSONATE ANY LOGIN' WHEN n < 300 THEN 'ALTER ANY LOGIN' ELSE 'CONNECT' END AS permission_name,
  CASE (k + n) % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'W' WHEN 2 THEN 'D' ELSE 'R' END AS state
FROM (SELECT {_IID}, c_custkey AS k, EACH(2,3,5,8,102,105,108,203,207,302,303) AS n FROM {{customer}}) s"""

_DBP = "(SELECT instance_id, database_id, name AS database_name, EACH(%s) AS n FROM {databases})"

SQL["db_principals"] = f"""
SELECT instance_id, database_name, CAST(n AS BIGINT) AS principal_id,
  CASE n WHEN 0 THEN 'public' WHEN 1 THEN 'dbo' WHEN 2 THEN 'guest' WHEN 5 THEN 'user5' WHEN 6 THEN 'orphan6' WHEN 7 THEN 'app_role' WHEN 8 THEN 'RSExecRole' WHEN 9 THEN 'long9' WHEN 10 THEN 'contained10'
    WHEN 16384 THEN 'db_owner' WHEN 16385 THEN 'db_accessadmin' WHEN 16386 THEN 'db_securityadmin' ELSE 'db_ddladmin' END AS name,
  CASE n WHEN 1 THEN CASE WHEN database_id % 5 = 0 THEN NULL ELSE '0x0' || CAST(1 + database_id % 3 AS STRING) END WHEN 2 THEN '0x00' WHEN 5 THEN '0x08' WHEN 6 THEN CASE WHEN database_id % 7 = 0 THEN NULL ELSE '0xDEADBEEF' END
    WHEN 9 THEN '0x' || repeat('AB', 29) WHEN 10 THEN '0xCAFE' END AS sid,
  CASE WHEN n IN (0, 7, 8) OR n >= 16384 THEN 'R' ELSE 'S' END AS type, CASE n WHEN 10 THEN 'DATABASE' WHEN 6 THEN 'INSTANCE' WHEN 5 THEN 'INSTANCE' WHEN 9 THEN 'INSTANCE' ELSE 'NONE' END AS authentication_type_desc
FROM {_DBP % '0,1,2,5,6,7,8,9,10,16384,16385,16386,16387'} s"""

SQL["db_role_members"] = f"""
SELECT instance_id, database_name, CAST(16384 + n % 4 AS BIGINT) AS role_principal_id, CASE WHEN n < 4 THEN CAST(1 AS BIGINT) WHEN n < 8 THEN CAST(5 AS BIGINT) WHEN n < 12 THEN CAST(7 AS BIGINT) ELSE CAST(8 AS BIGINT) END AS member_principal_id
FROM {_DBP % '0,4,5,6,7,8,10,12'} s WHERE (database_id + n) % 3 <> 0"""

SQL["db_permissions"] = f"""
SELECT instance_id, database_name, CAST(CASE WHEN n % 2 = 1 THEN 0 ELSE 5 END AS BIGINT) AS grantee_principal_id,
  CAST(CASE WHEN n > 10 THEN 0 WHEN n = 9 THEN 1 WHEN n = 7 THEN 4 WHEN n = 5 THEN 3 WHEN n = 3 THEN 6 WHEN n = 1 THEN 0 ELSE 3 END AS INTEGER) AS class,
  CAST(CASE WHEN n > 10 OR n = 1 THEN 0 ELSE n END AS BIGINT) AS major_id, CAST(0 AS BIGINT) AS minor_id,
  CASE WHEN n = 11 THEN 'VIEW ANY COLUMN ENCRYPTION KEY DEFINITION' WHEN n = 13 THEN 'VIEW ANY COLUMN MASTER KEY DEFINITION' WHEN n = 1 THEN 'CONNECT' ELSE 'EXECUTE' END AS permission_name,
  CASE (database_id + n) % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'W' ELSE 'G' END AS state
FROM {_DBP % '1,2,3,4,5,7,9,11,13'} s"""

SQL["securables"] = f"""
SELECT instance_id, database_name, CAST(CASE n WHEN 0 THEN 0 WHEN 5 THEN 3 WHEN 7 THEN 4 WHEN 3 THEN 6 ELSE 5 END AS INTEGER) AS class, CAST(n AS BIGINT) AS id,
  CASE n WHEN 0 THEN database_name WHEN 5 THEN 'schema5' WHEN 7 THEN 'app_role' ELSE 'obj' || CAST(n AS STRING) END AS name FROM {_DBP % '0,3,5,7,9'} s WHERE NOT (n = 3 AND database_id % 2 = 0)"""

SQL["credentials"] = f"""
SELECT instance_id, CAST(n AS BIGINT) AS credential_id, CASE n WHEN 1 THEN '##xp_cmdshell_proxy_account##' ELSE 'cred' || CAST(n AS STRING) END AS name,
  CASE n WHEN 1 THEN 'CORP' || chr(92) || 'cmd' WHEN 2 THEN 'CORP' || chr(92) || 'USER3' ELSE 'nobody' END AS credential_identity FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3) AS n FROM {{customer}}) s WHERE n > 1 OR k % 9 = 0"""

SQL["proxies"] = f"""
SELECT instance_id, CAST(n AS BIGINT) AS credential_id, 'proxy' || CAST(n AS STRING) AS name, (k + n) % 3 <> 0 AS enabled FROM (SELECT {_IID}, c_custkey AS k, EACH(2,3) AS n FROM {{customer}}) s"""

SQL["linked_servers"] = f"""
SELECT instance_id, CAST(n AS BIGINT) AS server_id, 'LINK' || CAST(n AS STRING) AS name, 'src' || CAST(k % 5 AS STRING) AS data_source, CASE WHEN k % 2 = 0 THEN 'SQL Server' END AS product, 'MSOLEDBSQL' AS provider,
  n > 0 AS is_linked FROM (SELECT {_IID}, c_custkey AS k, EACH(0,1,2,3) AS n FROM {{customer}}) s WHERE n <= k % 4"""

SQL["linked_logins"] = f"""
SELECT instance_id, CAST(n % 10 AS BIGINT) AS server_id, CASE WHEN n < 10 THEN CAST(0 AS BIGINT) ELSE CAST(n / 10 + 1 AS BIGINT) END AS local_principal_id, (k + n) % 3 = 0 AS uses_self_credential,
  CASE (k + n) % 5 WHEN 0 THEN 'SA' WHEN 1 THEN 'remote' || CAST(n AS STRING) WHEN 2 THEN 'sa' END AS remote_name FROM (SELECT {_IID}, c_custkey AS k, EACH(0,1,2,3,11,12,31,110) AS n FROM {{customer}}) s""".replace("CAST(n / 10 + 1 AS BIGINT)", "CAST(floor(n / 10) + 1 AS BIGINT)")

SQL["jobs"] = f"""
SELECT instance_id, CAST(n AS BIGINT) AS job_id, 'job' || CAST(n AS STRING) AS name, (k + n) % 4 <> 0 AS enabled, CASE n WHEN 1 THEN '0x01' WHEN 2 THEN '0x05' WHEN 3 THEN '0x08' WHEN 4 THEN '0xFFFF' ELSE '0x03' END AS owner_sid
FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3,4,5) AS n FROM {{customer}}) s"""

SQL["schedules"] = f"""
SELECT instance_id, CAST(n AS BIGINT) AS schedule_id, 'sched' || CAST(n AS STRING) AS name, CASE WHEN n = 2 THEN 64 ELSE 4 END AS freq_type, (k + n) % 5 <> 0 AS enabled FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3) AS n FROM {{customer}}) s"""

SQL["job_schedules"] = f"""
SELECT instance_id, CAST(n AS BIGINT) AS job_id, CAST(1 + (k + n) % 4 AS BIGINT) AS schedule_id FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3,5) AS n FROM {{customer}}) s WHERE (k + n) % 6 <> 0"""

SQL["alerts"] = f"""
SELECT instance_id, 'alert' || CAST(n AS STRING) AS name, CAST(CASE WHEN n < 100 THEN n ELSE 0 END AS INTEGER) AS severity, CAST(CASE WHEN n >= 100 THEN n ELSE 0 END AS INTEGER) AS message_id, (k + n) % 6 <> 0 AS enabled
FROM (SELECT {_IID}, c_custkey AS k, EACH(19,20,21,22,23,24,25,823,824,825,1205) AS n FROM {{customer}}) s WHERE (k + n) % 7 <> 0"""

# The customers of these segments run availability groups.
_CLUSTERED = "c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')"
_AG = f"(SELECT 'I' || CAST(c_custkey AS STRING) AS instance_id, c_custkey AS k, EACH(%s) AS n FROM {{customer}} WHERE {_CLUSTERED})"
_GID = "'g' || CAST(k AS STRING) || '_' || CAST(n % 2 AS STRING) AS group_id"
_GNAME = "'AG' || CAST(n % 2 AS STRING) AS group_name"

SQL["ag_groups"] = f"""
SELECT instance_id, {_GID}, {_GNAME}, CASE WHEN (k + n) % 3 = 0 THEN 'SECONDARY' ELSE 'PRIMARY' END AS role_desc, CASE WHEN (k + n) % 4 = 0 THEN '0x01' WHEN (k + n) % 4 = 1 THEN '0x03' WHEN (k + n) % 4 = 2 THEN '0x08' ELSE '0xFFFF' END AS owner_sid,
  CASE (k + n) % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary_only' ELSE 'none' END AS backup_preference_desc, CAST((k + n) % 3 AS INTEGER) AS cluster_type, (k + n) % 5 = 0 AS is_contained, (k + n) % 2 = 0 AS db_failover,
  (k + n) % 7 = 0 AS dtc_support, CAST(CASE (k + n) % 3 WHEN 0 THEN 30000 WHEN 1 THEN 20000 ELSE 60000 END AS INTEGER) AS health_check_timeout FROM {_AG % '0,1'} s"""

SQL["ag_replicas"] = f"""
SELECT instance_id, {_GID}, 'r' || CAST(k AS STRING) || '_' || CAST(n AS STRING) AS replica_id, {_GNAME}, 'NODE' || CAST(floor(n / 2) AS STRING) || CASE WHEN k % 4 = 0 THEN '' ELSE chr(92) || 'INST' END AS server_instance, n < 2 AS is_local,
  CASE WHEN n < 2 THEN 'PRIMARY' ELSE 'SECONDARY' END AS role_desc, CASE WHEN (k + n) % 5 = 0 THEN 'ASYNCHRONOUS_COMMIT' ELSE 'SYNCHRONOUS_COMMIT' END AS availability_mode_desc,
  CASE WHEN (k + n) % 7 = 0 THEN 'MANUAL' ELSE 'AUTOMATIC' END AS failover_mode_desc, 'ALL' AS primary_allow_desc, CASE WHEN (k + n) % 3 = 0 THEN 'NO' ELSE 'READ_ONLY' END AS secondary_allow_desc, CAST((k + n) % 6 AS INTEGER) AS seeding_mode,
  CAST(8 + (k + n) % 8 AS INTEGER) AS session_timeout, 'TCP://node' || CAST(n AS STRING) || ':5022' AS endpoint_url, CASE WHEN (k + n) % 9 = 0 THEN 'DISCONNECTED' ELSE 'CONNECTED' END AS connected_state_desc,
  CASE WHEN k % 8 = 0 AND n = 3 THEN 'TCP://route' END AS read_only_routing_url FROM {_AG % '0,1,2,3,4,5'} s""".replace("CAST(floor(n / 2) AS STRING)", "CAST(CAST(floor(n / 2) AS INTEGER) AS STRING)")

SQL["ag_databases"] = f"""
SELECT instance_id, {_GID}, 'r' || CAST(k AS STRING) || '_' || CAST(n AS STRING) AS replica_id, {_GNAME}, 'NODE' || CAST(CAST(floor(n / 2) AS INTEGER) AS STRING) AS server_instance, 'db_' || CAST(o_orderkey AS STRING) AS database_name,
  'd' || CAST(o_orderkey AS STRING) AS group_database_id, CAST(5 + o_orderkey AS BIGINT) AS database_id, CASE WHEN (o_orderkey + n) % 9 = 0 THEN NULL ELSE 'ONLINE' END AS database_state_desc,
  CASE (o_orderkey + n) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'SYNCHRONIZING' ELSE 'SYNCHRONIZED' END AS synchronization_state_desc, n < 2 AND k % 3 <> 0 AS is_primary_replica, n < 2 AS is_local, (o_orderkey + n) % 8 <> 0 AS is_database_joined,
  CASE WHEN (o_orderkey + n) % 12 = 5 THEN NULL ELSE (o_orderkey + n) % 10 = 0 END AS is_suspended, (o_orderkey + n) % 6 <> 0 AS is_failover_ready, CASE WHEN (o_orderkey + n) % 5 = 0 THEN NULL ELSE (o_orderkey + n) % 8 END AS secondary_lag_seconds
FROM (SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, o_custkey AS k, o_orderkey, EACH(0,1,2,3,4,5) AS n FROM {{orders}} INNER JOIN {{customer}} ON c_custkey = o_custkey WHERE {_CLUSTERED}) s WHERE n % 2 = o_orderkey % 2"""

SQL["ag_listeners"] = f"""
SELECT instance_id, {_GID}, 'l' || CAST(n AS STRING) AS listener_id, {_GNAME}, 'lsn' || CAST(n % 2 AS STRING) || '_' || CAST(k AS STRING) AS dns_name, 1433 AS port, '10.1.' || CAST(n AS STRING) || '.5' AS ip_address, '10.1.0.0' AS subnet_ip, 24 AS subnet_prefix,
  CASE WHEN (k + n * 3) % 5 IN (0, 1) THEN 'OFFLINE' WHEN (k + n) % 11 = 0 THEN 'FAILED' ELSE 'ONLINE' END AS ip_state FROM {_AG % '0,1,2'} s"""

SQL["cluster_members"] = f"""
SELECT instance_id, 'NODE' || CAST(n AS STRING) AS member_name, CASE WHEN n = 3 THEN 'FILE_SHARE_WITNESS' ELSE 'CLUSTER_NODE' END AS member_type_desc, CASE WHEN (k + n * 5) % 9 = 0 THEN 'DOWN' ELSE 'UP' END AS member_state_desc,
  CASE WHEN (k + n) % 3 = 0 THEN 0 ELSE 1 END AS number_of_quorum_votes FROM {_AG % '0,1,2,3'} s"""

SQL["endpoints"] = f"""
SELECT instance_id, CAST(7 AS BIGINT) AS endpoint_id, 'Hadr_endpoint' AS name, CAST(1 + (k / 2) % 9 AS BIGINT) AS principal_id, 4 AS type, CASE WHEN k % 10 = 0 THEN 'STOPPED' ELSE 'STARTED' END AS state_desc, 'NTLM' AS connection_auth_desc,
  CASE WHEN k % 6 = 0 THEN 'ep_cert' END AS certificate_name, CASE WHEN k % 6 = 0 THEN NTZ '2002-02-02 00:00:00' END AS certificate_expiry FROM {_AG % '0'} s""".replace("CAST(1 + (k / 2) % 9 AS BIGINT)", "CAST(1 + k % 9 AS BIGINT)")

SQL["xe_events"] = """
SELECT 'I' || CAST(user_id AS STRING) AS instance_id, CASE WHEN event_type = 'view' THEN 'error_reported' ELSE 'availability_replica_state_change' END AS object_name,
  '<event name="x" timestamp="' || replace(CAST(ts - INTERVAL '8216' DAY AS STRING), ' ', 'T') || 'Z"><data name="previous_state"><value>1</value><text>' || event_type || '</text></data><data name="current_state"><value>2</value><text>'
  || CASE WHEN value < 10 THEN 'RESOLVING_NORMAL' ELSE 'PRIMARY_NORMAL' END || '</text></data><data name="availability_group_name"><value>AG' || CAST(event_id % 5 AS STRING) || '</value></data></event>' AS event_data FROM {events}"""

SQL["wait_stats"] = f"""
SELECT instance_id, CASE n WHEN 1 THEN 'HADR_SYNC_COMMIT' ELSE 'WRITELOG' END AS wait_type, k * 10 AS wait_time_ms, k % 500 AS waiting_tasks_count FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2) AS n FROM {{customer}}) s"""

SQL["suspect_pages"] = """
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, CAST(5 + o_orderkey AS BIGINT) AS database_id, CAST(CASE WHEN l_orderkey % 12 = 1 THEN 1 + (l_linenumber + o_orderkey) % 5 ELSE 5 END AS INTEGER) AS event_type, CAST(l_linenumber AS INTEGER) AS error_count, l_shipdate AS last_update_date
FROM {lineitem} l INNER JOIN {orders} o ON o_orderkey = l_orderkey"""

SQL["page_repairs"] = """
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, CAST(5 + o_orderkey AS BIGINT) AS database_id, l_shipdate AS modification_time FROM {lineitem} l INNER JOIN {orders} o ON o_orderkey = l_orderkey"""

SQL["sessions"] = """
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, CAST(50 + o_orderkey AS BIGINT) AS session_id, 'login' || CAST(o_orderkey % 9 AS STRING) AS login_name, 'SELECT ' || o_orderpriority || ' FROM t' || CAST(o_orderkey AS STRING) AS batch_text FROM {orders}"""

SQL["session_space"] = """
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, CAST(50 + o_orderkey AS BIGINT) AS session_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE floor(o_totalprice / 10) END AS BIGINT) AS user_alloc, CAST(o_orderkey % 50 AS BIGINT) AS user_dealloc,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey % 900 END AS BIGINT) AS internal_alloc, CAST(o_orderkey % 7 AS BIGINT) AS internal_dealloc FROM {orders}"""

SQL["task_space"] = """
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, CAST(50 + o_orderkey AS BIGINT) AS session_id, CAST(CASE WHEN l_linenumber < 4 THEN 0 ELSE l_partkey END AS BIGINT) AS user_alloc, CAST(l_suppkey % 30 AS BIGINT) AS user_dealloc,
  CAST(CASE WHEN l_linenumber < 5 THEN 0 ELSE l_suppkey END AS BIGINT) AS internal_alloc, CAST(l_linenumber AS BIGINT) AS internal_dealloc FROM {lineitem} l INNER JOIN {orders} o ON o_orderkey = l_orderkey"""

SQL["file_space"] = """
SELECT instance_id, file_id, size AS total_pages, space_used AS allocated_pages, size - space_used AS unallocated_pages, CAST(floor(space_used / 3) AS BIGINT) AS user_pages, CAST(floor(space_used / 5) AS BIGINT) AS internal_pages, CAST(floor(space_used / 7) AS BIGINT) AS version_store_pages
FROM {files} WHERE database_id = 2 AND type = 0"""

SQL["transactions"] = """
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, CAST(50 + o_orderkey AS BIGINT) AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(7 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS database_id, o_orderdate AS begin_time, o_orderkey % 77 AS log_record_count,
  CAST(CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE floor(o_totalprice) * 700 END AS BIGINT) AS log_bytes_used, CAST(floor(o_totalprice) * 900 AS BIGINT) AS log_bytes_reserved FROM {orders}"""

SQL["requests"] = """
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, CAST(50 + o_orderkey AS BIGINT) AS session_id, CASE o_orderkey % 6 WHEN 0 THEN 'PAGELATCH_SH' WHEN 1 THEN 'PAGELATCH_UP' WHEN 2 THEN 'PAGELATCH_EX' WHEN 3 THEN 'PAGELATCH_KP' WHEN 4 THEN 'PAGEIOLATCH_SH' ELSE 'CXPACKET' END AS wait_type,
  CASE WHEN o_orderkey % 5 = 0 THEN '20' ELSE '2' END || ':' || CAST(1 + o_orderkey % 3 AS STRING) || ':' || CAST(o_orderkey % 40 AS STRING) AS wait_resource, o_orderkey % 4 AS blocking_session_id, 'SELECT' AS command,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 14 END AS INTEGER) AS statement_start, CAST(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 30 END AS INTEGER) AS statement_end, 'SELECT ' || o_orderpriority || ' FROM t' || CAST(o_orderkey AS STRING) AS batch_text
FROM {orders}"""

SQL["page_info"] = """
SELECT DISTINCT instance_id, CAST(2 AS BIGINT) AS database_id, CAST(1 + p % 3 AS BIGINT) AS file_id, CAST(p AS BIGINT) AS page_id, 'obj' || CAST(p % 6 AS STRING) AS object_name, CAST(p % 6 AS BIGINT) AS object_id, CAST(p % 2 AS INTEGER) AS index_id,
  CASE p % 7 WHEN 0 THEN 'SGAM_PAGE' WHEN 1 THEN 'GAM_PAGE' WHEN 2 THEN 'PFS_PAGE' WHEN 3 THEN 'DATA_PAGE' WHEN 4 THEN 'INDEX_PAGE' ELSE 'IAM_PAGE' END AS page_type_desc
FROM (SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, o_orderkey % 40 AS p FROM {orders}) s"""

SQL["os_memory"] = f"SELECT {_IID}, CAST(8388608 AS BIGINT) AS total_physical_kb, CAST(524288 + (c_custkey % 5) * 262144 AS BIGINT) AS available_physical_kb, CAST(CASE WHEN c_custkey % 3 = 1 THEN 0 ELSE c_custkey * 700 END AS BIGINT) AS locked_page_kb FROM {{customer}}"

SQL["memory_dumps"] = """
SELECT 'I' || CAST(o_custkey AS STRING) AS instance_id, 'dump' || CAST(o_orderkey AS STRING) AS filename, o_orderdate + CAST(CASE WHEN o_orderdate <= NTZ '2001-07-03 00:00:00' THEN 30 ELSE 0 END AS INTEGER) * INTERVAL '1' DAY AS creation_time FROM {orders}"""

SQL["cpu_nodes"] = f"SELECT instance_id, CAST(n AS INTEGER) AS node_id, CASE n WHEN 2 THEN 'ONLINE DAC' ELSE 'ONLINE' END AS node_state_desc, CAST(CASE WHEN k % 5 = 0 THEN NULL ELSE n END AS INTEGER) AS memory_node_id FROM (SELECT {_IID}, c_custkey AS k, EACH(0,1,2) AS n FROM {{customer}}) s"

SQL["cpu_schedulers"] = f"SELECT instance_id, CAST(n AS INTEGER) AS scheduler_id, CAST(n % 3 AS INTEGER) AS parent_node_id, CASE WHEN (k + n) % 6 = 0 THEN 'VISIBLE OFFLINE' ELSE 'VISIBLE ONLINE' END AS status FROM (SELECT {_IID}, c_custkey AS k, EACH(0,1,2,3,4,5,6,7) AS n FROM {{customer}}) s"

SQL["rg_groups"] = f"SELECT instance_id, 'wg' || CAST(n AS STRING) AS group_name, CAST(1 + n % 2 AS INTEGER) AS pool_id, CASE WHEN (k + n) % 3 = 0 THEN CAST(500 + n AS DOUBLE) END AS max_tempdb_mb, CASE WHEN (k + n) % 4 = 0 THEN CAST(25 + n AS DOUBLE) END AS max_tempdb_percent FROM (SELECT {_IID}, c_custkey AS k, EACH(0,1,2) AS n FROM {{customer}}) s"

SQL["rg_pools"] = f"SELECT instance_id, CAST(n AS INTEGER) AS pool_id, 'pool' || CAST(n AS STRING) AS pool_name FROM (SELECT {_IID}, EACH(1,2) AS n FROM {{customer}}) s"

SQL["resource_governor"] = f"SELECT {_IID}, c_custkey % 2 = 1 AS is_enabled FROM {{customer}}"

SQL["server_triggers"] = f"SELECT instance_id, CASE n WHEN 1 THEN 'rds_trigger' WHEN 2 THEN 'rdsXtrigger' ELSE 'audit_trigger' END AS name, (k + n) % 4 = 0 AS is_disabled, (k + n) % 5 = 0 AS is_ms_shipped FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3) AS n FROM {{customer}}) s"

SQL["change_tracking"] = "SELECT instance_id, database_id FROM {databases} WHERE is_merge_published"

SQL["xe_sessions"] = f"SELECT instance_id, CASE n WHEN 1 THEN 'AlwaysOn_health' WHEN 2 THEN 'system_health' WHEN 3 THEN 'telemetry_xevents' WHEN 4 THEN 'x$A$y' ELSE 'custom' || CAST(k % 3 AS STRING) END AS name FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3,4,5) AS n FROM {{customer}}) s WHERE (k + n) % 3 <> 0"

SQL["audits"] = f"SELECT instance_id, CASE n WHEN 1 THEN 'Audit1' ELSE 'mySQLBeaconAudit' END AS name, CAST((k + n) % 3 AS INTEGER) AS status FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2) AS n FROM {{customer}}) s"

SQL["routines"] = f"SELECT instance_id, 'dbo' AS routine_schema, 'proc' || CAST(n AS STRING) AS routine_name, (k + n) % 9 = 0 AS is_startup FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2) AS n FROM {{customer}}) s"

SQL["local_admins"] = f"SELECT instance_id, CASE n WHEN 1 THEN 'CORP' || chr(92) || 'USER3' WHEN 2 THEN 'CORP' || chr(92) || 'svc' ELSE 'CORP' || chr(92) || 'admins' END AS account_name, CASE n WHEN 3 THEN 'group' ELSE 'user' END AS account_type FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3) AS n FROM {{customer}}) s WHERE (k + n) % 2 = 0"

SQL["directory_accounts"] = f"SELECT instance_id, CASE n WHEN 3 THEN 'corp' || chr(92) || 'USER3' WHEN 4 THEN 'NT SERVICE' || chr(92) || 'MSSQLSERVER' WHEN 7 THEN 'CORP' || chr(92) || 'group7' ELSE 'NT AUTHORITY' || chr(92) || 'SYSTEM' END AS account_name FROM (SELECT {_IID}, c_custkey AS k, EACH(3,4,7,9) AS n FROM {{customer}}) s WHERE (k + n) % 5 <> 0"

SQL["installed_instances"] = f"SELECT instance_id, 'HOST' || CAST(k % 400 AS STRING) AS host, 'INST' || CAST(n AS STRING) AS installed_name FROM (SELECT {_IID}, c_custkey AS k, EACH(1,2,3) AS n FROM {{customer}}) s WHERE n <= 1 + k % 3"

_MARK = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _spark_text(sql: str) -> str:
    sql = re.sub(r"EACH\(([^()]*)\)", r"explode(array(\1))", sql).replace("NTZ '", "TIMESTAMP_NTZ '")
    return re.sub(r"HASH256\((.*)\) AS digest", r"sha2(\1, 256) AS digest", sql)


def _duck_text(sql: str) -> str:
    sql = re.sub(r"EACH\(([^()]*)\)", r"unnest([\1])", sql).replace("NTZ '", "TIMESTAMP '").replace("HASH256(", "sha256(")
    return _MARK.sub(r"\1", sql).replace("{{", "{").replace("}}", "}")


def derived_fleet(t: Tables, stage: Sequence[str] = ()) -> Fleet:
    """Fleet over the given tables; each table is a view that Spark derives when a rule reads it, but for
    those a query reads many times and asks to stage."""
    fleet: Fleet

    def read(table: str) -> DataFrame:
        sql = _spark_text(SQL[table])
        names = set(_MARK.findall(sql))
        return t.spark.sql(sql, **{n: fleet[n] if n in SQL else getattr(t, n) for n in names})

    fleet = Fleet(t.spark, read, stage)
    return fleet


# Names the comparison SQL may use besides the tables: plain SQL of the comparison engine.
HELPERS: dict[str, str] = {}


def with_tables(sql: str) -> str:
    """The comparison SQL with the tables and helpers it names put in front, each before its users."""
    ready: dict[str, str] = {}

    def words(text: str) -> list[str]:
        return [n for n in (*HELPERS, *SQL) if re.search(rf"\b{n}\b", text)]

    def add(name: str) -> None:
        if name in ready:
            return
        for other in ([n for n in _MARK.findall(SQL[name]) if n in SQL] if name in SQL else [n for n in words(HELPERS[name]) if n != name]):
            add(other)
        ready[name] = _duck_text(SQL[name]) if name in SQL else HELPERS[name]

    for name in words(sql):
        add(name)
    views = ",\n".join(f"{n} AS MATERIALIZED ({text.strip()})" for n, text in ready.items())
    body = sql.strip()
    return f"WITH {views}\n{body}" if views else body
