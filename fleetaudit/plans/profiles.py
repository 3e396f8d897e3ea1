"""The five audit profiles: which checks each runs, and the report over their findings."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.stage import staged_union
from ..operators import report
from ..params import AuditParams
from ..sources import Fleet
from . import availability, discovery, integrity, performance, recoverability, reliability, security
from .catalogue import rules_for
from .facts import Facts

# Profile to its parts by category; each part gives a list of raw findings.
PROFILES = {
    "ag": [discovery.group_profile, availability.group_profile, integrity.group_profile, reliability.group_profile],
    "backup": [recoverability.backup_profile, integrity.backup_profile, reliability.backup_profile, performance.backup_profile],
    "health": [discovery.health_profile, recoverability.health_profile, security.health_profile, availability.health_profile,
               integrity.health_profile, reliability.health_profile, performance.health_profile],
    "security": [discovery.security_profile, recoverability.security_profile, security.security_profile, reliability.security_profile],
    "tempdb": [lambda f: [security.tempdb_encrypted(f)], reliability.tempdb_profile, performance.tempdb_profile],
}


def findings_of(profile: str, facts: Facts) -> list[DataFrame]:
    return [df for part in PROFILES[profile] for df in part(facts)]


def audit(profile: str, fleet: Fleet, params: AuditParams, min_importance: int | None = None,
          discovery_rows: bool | None = None) -> DataFrame:
    """Findings report of one profile.

    Discovery rows show in the health and security profiles only, unless asked for. The security
    profile sorts by check name, the others by category and check.
    """
    if discovery_rows is None:
        discovery_rows = profile in ("health", "security") and min_importance is None
    parts = findings_of(profile, Facts(fleet, params))
    if params.stage_facts:
        parts = [staged_union(parts, f"findings-{profile}")]
    return report(parts, rules_for(profile), params.as_of, min_importance, discovery_rows,
                  "by_name" if profile == "security" else "standard", f"Fleet audit: {profile}")
