"""Columns of the fleet tables. Every table starts with ``instance_id`` and ``snapshot_ts``.

Times are the instance's local times without zone; security ids are hex strings.
"""
from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

SA_SID = "0x01"
LOCAL_SYSTEM_SID = "0x010100000000000512000000"

COLUMNS: dict[str, str] = {
    "instances": "machine_name string, instance_name string, server_name_var string, server_name_prop string, "
                 "edition string, engine_edition int, product_version string, data_path string, log_path string, "
                 "backup_path string, cpu_count int, hyperthread_ratio int, physical_memory_kb bigint, "
                 "start_time timestamp_ntz, utc_offset_minutes int, net_address string, transport string, tcp_port int, "
                 "collected_as_sysadmin boolean, service_tier string, cluster_name string, quorum_type string, "
                 "quorum_state string, can_connect_endpoint string, log_space_used_bytes bigint",
    "databases": "database_id bigint, name string, owner_sid string, state int, state_desc string, "
                 "recovery_model_desc string, user_access_desc string, page_verify_option_desc string, "
                 "compatibility_level int, create_date timestamp_ntz, source_database_id bigint, is_in_standby boolean, "
                 "is_read_only boolean, is_encrypted boolean, is_trustworthy_on boolean, is_auto_shrink_on boolean, "
                 "is_auto_close_on boolean, is_auto_create_stats_on boolean, is_auto_update_stats_on boolean, "
                 "is_recursive_triggers_on boolean, is_parameterization_forced boolean, is_cdc_enabled boolean, "
                 "is_published boolean, is_subscribed boolean, is_merge_published boolean, is_distributor boolean, "
                 "is_accelerated_database_recovery_on boolean, delayed_durability int, containment int, updateability string",
    "ag_membership": "database_name string, group_id string, group_name string, is_preferred_backup_replica boolean",
    "backup_sets": "backup_set_id bigint, server_name string, database_name string, type string, recovery_model string, "
                   "is_copy_only boolean, is_snapshot boolean, is_password_protected boolean, has_backup_checksums boolean, "
                   "encryptor_type string, encryptor_thumbprint string, backup_start_date timestamp_ntz, "
                   "backup_finish_date timestamp_ntz, backup_size decimal(20,0), compressed_backup_size decimal(20,0), "
                   "media_set_id bigint, user_name string",
    "backup_media": "media_set_id bigint, family_sequence_number int, physical_device_name string, "
                    "logical_device_name string, device_type int, of_set_id bigint",
    "restore_history": "destination_database_name string, restore_date timestamp_ntz, user_name string, "
                       "restore_type string, replace boolean, recovery boolean, stop_at timestamp_ntz",
    "configurations": "name string, value bigint, value_in_use bigint",
    "registry_settings": "key string, value string",
    "error_log": "log_date timestamp_ntz, process_info string, message string",
    "db_info": "database_name string, field string, value string",
    "files": "database_id bigint, file_id int, type int, type_desc string, name string, physical_name string, "
             "initial_size bigint, size bigint, max_size bigint, growth bigint, space_used bigint, is_percent_growth boolean, "
             "data_space_id int, filegroup string",
    "io_stats": "database_id bigint, file_id int, num_of_reads bigint, num_of_writes bigint, io_stall_read_ms bigint, "
                "io_stall_write_ms bigint",
    "drives": "drive string, volume string, total_mb decimal(18,0), free_mb decimal(18,0)",
    "certificates": "name string, thumbprint string, pvt_key_last_backup_date timestamp_ntz, expiry_date timestamp_ntz",
    "encryption_keys": "database_id bigint, encryptor_thumbprint string, key_algorithm string, key_length int",
    "db_log_stats": "database_id bigint, total_vlf_count bigint",
    "server_services": "servicename string, service_account string, status_desc string, startup_type_desc string, "
                       "instant_file_initialization_enabled string",
    "trace_flags": "trace_flag string, status boolean, is_global boolean, is_session boolean",
    "server_principals": "principal_id bigint, name string, sid string, type string, is_disabled boolean, "
                         "deny_login boolean, create_date timestamp_ntz",
    "sql_logins": "principal_id bigint, name string, sid string, is_disabled boolean, salt string, digest string",
    "server_role_members": "role_name string, member_name string",
    "server_permissions": "grantee_principal_id bigint, class int, major_id bigint, type string, permission_name string, state string",
    "db_principals": "database_name string, principal_id bigint, name string, sid string, type string, authentication_type_desc string",
    "db_role_members": "database_name string, role_principal_id bigint, member_principal_id bigint",
    "db_permissions": "database_name string, grantee_principal_id bigint, class int, major_id bigint, minor_id bigint, "
                      "permission_name string, state string",
    "securables": "database_name string, class int, id bigint, name string",
    "credentials": "credential_id bigint, name string, credential_identity string",
    "proxies": "credential_id bigint, name string, enabled boolean",
    "linked_servers": "server_id bigint, name string, data_source string, product string, provider string, is_linked boolean",
    "linked_logins": "server_id bigint, local_principal_id bigint, uses_self_credential boolean, remote_name string",
    "jobs": "job_id bigint, name string, enabled boolean, owner_sid string",
    "job_schedules": "job_id bigint, schedule_id bigint",
    "schedules": "schedule_id bigint, name string, freq_type int, enabled boolean",
    "alerts": "name string, severity int, message_id int, enabled boolean",
    "ag_groups": "group_id string, group_name string, role_desc string, owner_sid string, backup_preference_desc string, "
                 "cluster_type int, is_contained boolean, db_failover boolean, dtc_support boolean, health_check_timeout int",
    "ag_replicas": "group_id string, replica_id string, group_name string, server_instance string, is_local boolean, "
                   "role_desc string, availability_mode_desc string, failover_mode_desc string, primary_allow_desc string, "
                   "secondary_allow_desc string, seeding_mode int, session_timeout int, endpoint_url string, "
                   "connected_state_desc string, read_only_routing_url string",
    "ag_databases": "group_id string, replica_id string, group_name string, server_instance string, database_name string, "
                    "group_database_id string, database_id bigint, database_state_desc string, synchronization_state_desc string, "
                    "is_primary_replica boolean, is_local boolean, is_database_joined boolean, is_suspended boolean, "
                    "is_failover_ready boolean, secondary_lag_seconds bigint",
    "ag_listeners": "group_id string, listener_id string, group_name string, dns_name string, port int, ip_address string, "
                    "subnet_ip string, subnet_prefix int, ip_state string",
    "cluster_members": "member_name string, member_type_desc string, member_state_desc string, number_of_quorum_votes int",
    "endpoints": "endpoint_id bigint, name string, principal_id bigint, type int, state_desc string, "
                 "connection_auth_desc string, certificate_name string, certificate_expiry timestamp_ntz",
    "xe_events": "object_name string, event_data string",
    "wait_stats": "wait_type string, wait_time_ms bigint, waiting_tasks_count bigint",
    "suspect_pages": "database_id bigint, event_type int, error_count int, last_update_date timestamp_ntz",
    "page_repairs": "database_id bigint, modification_time timestamp_ntz",
    "sessions": "session_id bigint, login_name string, batch_text string",
    "session_space": "session_id bigint, user_alloc bigint, user_dealloc bigint, internal_alloc bigint, internal_dealloc bigint",
    "task_space": "session_id bigint, user_alloc bigint, user_dealloc bigint, internal_alloc bigint, internal_dealloc bigint",
    "file_space": "file_id int, total_pages bigint, allocated_pages bigint, unallocated_pages bigint, user_pages bigint, "
                  "internal_pages bigint, version_store_pages bigint",
    "transactions": "session_id bigint, database_id bigint, begin_time timestamp_ntz, log_record_count bigint, "
                    "log_bytes_used bigint, log_bytes_reserved bigint",
    "requests": "session_id bigint, wait_type string, wait_resource string, blocking_session_id bigint, command string, "
                "statement_start int, statement_end int, batch_text string",
    "page_info": "database_id bigint, file_id bigint, page_id bigint, object_name string, object_id bigint, index_id int, "
                 "page_type_desc string",
    "os_memory": "total_physical_kb bigint, available_physical_kb bigint, locked_page_kb bigint",
    "memory_dumps": "filename string, creation_time timestamp_ntz",
    "cpu_nodes": "node_id int, node_state_desc string, memory_node_id int",
    "cpu_schedulers": "scheduler_id int, parent_node_id int, status string",
    "rg_groups": "group_name string, pool_id int, max_tempdb_mb double, max_tempdb_percent double",
    "rg_pools": "pool_id int, pool_name string",
    "resource_governor": "is_enabled boolean",
    "server_triggers": "name string, is_disabled boolean, is_ms_shipped boolean",
    "change_tracking": "database_id bigint",
    "xe_sessions": "name string",
    "audits": "name string, status int",
    "routines": "routine_schema string, routine_name string, is_startup boolean",
    "local_admins": "account_name string, account_type string",
    "directory_accounts": "account_name string",
    "installed_instances": "host string, installed_name string",
}


def ddl(table: str) -> str:
    return "instance_id string, snapshot_ts timestamp_ntz, " + COLUMNS[table]


@cache
def schema_of(table: str) -> StructType:
    return StructType.fromDDL(ddl(table))
