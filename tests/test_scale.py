"""What keeps the plans of a large fleet small: no guessed broadcast, and profiles whose parts are written one by one."""
import re

import pytest
from helpers import AS_OF, instance, table

from __spark_entry__ import queries
from fleetaudit.functions.stage import staged_union
from fleetaudit.params import AuditParams
from fleetaudit.plans import audit
from fleetaudit.session import BROADCASTS, prepare
from fleetaudit.sources import Fleet

FOLDER = "/root/testdata/sf0.01"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Customers pass for a small table by the size of their file, however many rows each unfolds into.
@pytest.mark.parametrize("name", ["checks_integrity_health", "checks_discovery_groups", "checks_availability_groups", "checks_performance_tempdb", "checks_security_logins",
                                  "checks_security_settings", "checks_security_databases", "report_group_instances"])
def test_only_constant_tables_are_broadcast_unasked(spark, name):
    p = physical(queries()[name](spark, FOLDER))
    sides = re.findall(r"BroadcastExchange[^\n]*\n((?:[^\n]*\n){3})", p)
    assert all("LocalTableScan" in side for side in sides) and "SortMergeJoin" in p


def test_limit_of_broadcasts_is_set_aside_and_back(spark):
    prepare(spark, asked_only=False)
    before = spark.conf.get(BROADCASTS, None)
    try:
        spark.conf.set(BROADCASTS, "256k")
        prepare(prepare(spark))
        assert spark.conf.get(BROADCASTS) == "-1"
        prepare(spark, asked_only=False)
        assert spark.conf.get(BROADCASTS) == "256k"
    finally:
        spark.conf.set(BROADCASTS, before) if before else spark.conf.unset(BROADCASTS)


def test_staged_union_is_one_scan_of_all_rows(spark):
    a = spark.sql("SELECT 'x' AS k, 1 AS n UNION ALL SELECT 'x', 1 UNION ALL SELECT NULL, NULL")
    b = spark.sql("SELECT 5000000000 AS n, 'y' AS k")
    out = staged_union([a, b, a.limit(0)], "test")
    p = physical(out)
    assert p.count("FileScan") == 1 and "Union" not in p
    assert out.schema == a.unionByName(b).schema
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("x", 1), ("x", 1), (None, None), ("y", 5000000000)], key=str)


@pytest.mark.parametrize("profile", ["ag", "security", "tempdb", "health", "backup"])
def test_report_of_staged_profile_starts_from_one_table(spark, profile):
    frames = {"instances": table(spark, "instances", [instance("A"), instance("B", product_version="12.0.2000.8")]),
              "ag_groups": table(spark, "ag_groups", [dict(instance_id="A", group_id="g", group_name="AG", owner_sid="0x02", backup_preference_desc="none", health_check_timeout=20000)]),
              "ag_replicas": table(spark, "ag_replicas", [dict(instance_id="A", group_id="g", group_name="AG", replica_id="r", server_instance="N", session_timeout=5)]),
              "server_principals": table(spark, "server_principals", [dict(instance_id="A", principal_id=2, name="x", sid="0x02", type="S")] * 2)}
    plain, staged = (audit(profile, Fleet.from_frames(spark, frames), AuditParams(AS_OF, stage_facts=on)) for on in (False, True))
    p = physical(staged)
    assert p.count("FileScan") == 1 and "SortMergeJoin" not in p and "hashpartitioning" not in p
    columns = ("case_no",) if "case_no" in plain.columns else ("issue", "database_name", "details", "metric")
    rows = lambda df: sorted(map(str, df.select("instance_id", "check_id", *columns).collect()))
    assert rows(staged) == rows(plain)
