"""Physical plans: scans, pushed filters, shuffles, joins."""
import re

import pytest

from __spark_entry__ import queries

FOLDER = "/root/testdata/sf0.01"


def plan(spark, name: str) -> str:
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def count(pattern: str, text: str) -> int:
    return len(re.findall(pattern, text))


def test_row_rules_scan_once_without_shuffle_and_push_down(spark):
    p = plan(spark, "o1_rule_scan")
    assert count("FileScan", p) == 1 and "Exchange" not in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_discount:double,l_tax:double,l_returnflag:string>" in p
    assert "PushedFilters: [Or(Or(" in p


def test_rule_tables_are_broadcast_only(spark):
    p = plan(spark, "o2_settings_rules")
    assert count("BroadcastHashJoin", p) == 1 and count("Exchange hashpartitioning", p) == 0


def test_scope_reaches_the_scan(spark):
    p = plan(spark, "o31_scope")
    assert "PushedFilters: [" in p and "GreaterThanOrEqual(o_orderdate" in p and "In(o_orderpriority" in p


@pytest.mark.parametrize("name", ["o4_missing_coverage", "o7_required_set"])
def test_anti_joins_shuffle_distinct_keys(spark, name):
    # The event side is aggregated before its shuffle.
    p = plan(spark, name)
    assert "LeftAnti" in p and re.search(r"HashAggregate\(keys=\[[^\]]*\], functions=\[\]", p)


def test_last_by_type_finds_its_rows_first(spark):
    p = plan(spark, "o25_last_by_type")
    assert "LeftSemi" in p and "Window" not in p and re.search(r"HashAggregate\(keys=\[o_custkey[^\]]*\], functions=\[partial_max", p)


def test_pairing_partitions_by_key_and_bucket(spark):
    p = plan(spark, "o11_pairing_summary")
    assert re.search(r"hashpartitioning\(user_id#\d+L, _bucket#\d+L", p)
    assert "partial_count_if" in p or "partial_count(" in p
    assert "CartesianProduct" not in p


# What the others return is read back from files.
@pytest.mark.parametrize("name", [n for n in queries() if not n.startswith(("stream_", "profile_", "source_", "report_findings_", "report_assessment"))])
def test_no_cross_join_and_no_single_partition(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "Exchange SinglePartition" not in p
    assert "PythonUDF" not in p and "BatchEvalPython" not in p
