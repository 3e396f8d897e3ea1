"""Reusable audit operators: DataFrames in, DataFrames out, column names as parameters."""
from .access import (credential_dictionary_audit, credential_dictionary_join, ownership_audit, privilege_audit, resolve_securable,
                     role_members)
from .coverage import (first_event, missing_coverage, objective_breach, recent_change,
                       required_set_missing, stale_last_event)
from .groups import (attributes_wide, conditional_sum_compare, group_heterogeneity, group_threshold,
                     label_dim, ratio_threshold, string_list)
from .history import backup_detail, chain_report, last_by_type_wide, latest_per_key, of_greatest
from .logtext import LogPattern, log_extract, state_changes
from .pairing import next_event_pairing, pairing_summary
from .report import Rule, reclassify, report, rule_dimension
from .scan import (RowRule, SettingRule, compare_cols, rule_scan, settings_drift, settings_pair,
                   settings_rules, settings_states)
from .scope import applicability, eligible_databases, scope
from .space import contention, session_space, space_summary, transaction_log_use
from .versions import snapshot_of, version_columns, version_gate

__all__ = [
    "LogPattern", "RowRule", "Rule", "SettingRule", "applicability", "attributes_wide", "backup_detail",
    "chain_report", "compare_cols", "conditional_sum_compare", "contention",
    "credential_dictionary_audit", "credential_dictionary_join", "eligible_databases", "first_event", "group_heterogeneity",
    "group_threshold", "label_dim", "last_by_type_wide", "latest_per_key", "log_extract", "of_greatest",
    "missing_coverage", "next_event_pairing", "objective_breach", "ownership_audit", "pairing_summary",
    "privilege_audit", "ratio_threshold", "recent_change", "reclassify", "report",
    "required_set_missing", "resolve_securable", "role_members", "rule_dimension", "rule_scan", "scope",
    "session_space", "settings_drift", "settings_pair", "settings_rules", "settings_states",
    "snapshot_of", "space_summary", "stale_last_event", "state_changes", "string_list",
    "transaction_log_use", "version_columns", "version_gate",
]
