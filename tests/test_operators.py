"""Operators on small tables: limits, nulls, other owners, ties."""
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, example, given, settings, strategies as st
from pyspark.sql import functions as F

from fleetaudit import operators as ops
from fleetaudit.functions import minutes_between, millis_between, parent_location, percent_of, quote_name, statement_slice

T0 = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_rule_scan_null_never_fires_and_cases_are_kept(spark):
    df = spark.createDataFrame([("a", 200), ("a", 201), ("b", None), ("b", 300)], "instance_id string, v int")
    v = F.col("v")
    out = ops.rule_scan(df, [ops.RowRule(1, v > 200, metric=v), ops.RowRule(2, v >= 300, object=F.lit("x"), case_no=1)])
    assert rows(out, "instance_id", "check_id", "case_no", "object_name", "metric") == [
        ("a", 1, 0, None, 201.0), ("b", 1, 0, None, 300.0), ("b", 2, 1, "x", None)]


def test_settings_rules_fold_names_and_gate_by_version(spark):
    df = spark.createDataFrame([("a", "XP_CmdShell", 1, 13.0), ("b", "xp_cmdshell", 1, 12.0), ("c", "xp_cmdshell", None, 15.0)],
                               "instance_id string, name string, value_in_use long, major double")
    out = ops.settings_rules(df, [ops.SettingRule(319, "xp_cmdshell", "=", 1, versions=(13, None)),
                                  ops.SettingRule(320, "xp_cmdshell", "any", versions=(None, 12))], version="major")
    assert rows(out, "instance_id", "check_id", "metric") == [("a", 319, 1.0), ("b", 320, 1.0)]


def test_settings_states_report_missing_keys(spark):
    instances = spark.createDataFrame([("a",), ("b",)], "instance_id string")
    reg = spark.createDataFrame([("a", "hideinstance", "1"), ("b", "HideInstance", "7")], "instance_id string, key string, value string")
    out = ops.settings_states(instances, reg, [(347, "HideInstance"), (349, "ForceEncryption")])
    assert rows(out, "instance_id", "check_id", "object_name") == [
        ("a", 347, "ENABLED"), ("a", 349, "UNKNOWN"), ("b", 347, "UNKNOWN"), ("b", 349, "UNKNOWN")]


def test_drift_tolerates_equivalent_values(spark):
    df = spark.createDataFrame([("min", 0, 16), ("min", 0, 17), ("max", 0, 16), ("max", 5, 5), ("max", None, 1)],
                               "name string, value long, value_in_use long")
    assert rows(ops.settings_drift(df, tolerated={"MIN": (0, 16)}), "name", "value", "value_in_use") == [("max", 0, 16), ("min", 0, 17)]


def test_stale_and_missing_are_disjoint_and_limit_is_inclusive(spark):
    entities = spark.createDataFrame([(k,) for k in "abcd"], "k string")
    events = spark.createDataFrame([("a", at(0)), ("b", at(1)), ("c", at(0)), ("c", at(50))], "k string, ts timestamp_ntz")
    as_of = at(7 * 86400)
    stale = ops.stale_last_event(entities, events, ["k"], "ts", "7 DAYS", as_of)
    assert rows(stale, "k") == [("a",)]
    assert rows(ops.missing_coverage(entities, events, ["k"]), "k") == [("d",)]


def test_objective_counts_minute_boundaries(spark):
    entities = spark.createDataFrame([(k,) for k in "abc"], "k string")
    events = spark.createDataFrame([("a", at(59)), ("b", at(61))], "k string, ts timestamp_ntz")
    out = ops.objective_breach(entities, events, ["k"], "ts", 9, at(600))
    # 00:00:59 to 00:10:00 crosses ten boundaries, 00:01:01 nine.
    assert rows(out, "k", "breach", "minutes_since") == [("a", "late", 10), ("c", "never", None)]


def test_required_set_version_range_and_other_owner(spark):
    instances = spark.createDataFrame([("a", 12.0), ("b", 13.0)], "instance_id string, major double")
    present = spark.createDataFrame([("a", "3226"), ("b", "7745")], "instance_id string, trace_flag string")
    required = [{"trace_flag": "3226"}, {"trace_flag": "2371", "max_version": 12.9}, {"trace_flag": "7745", "min_version": 13}]
    out = ops.required_set_missing(instances, required, present, ["trace_flag"], "major")
    assert rows(out, "instance_id", "trace_flag") == [("a", "2371"), ("b", "3226")]


def test_heterogeneity_ignores_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 1), ("b", 2), ("c", None)], "g string, v int")
    assert rows(ops.group_heterogeneity(df, ["g"], "v"), "g") == [("b",)]
    assert rows(ops.group_heterogeneity(df, ["g"], "v", members=True), "g", "v") == [("b", 1), ("b", 2)]
    assert rows(ops.group_heterogeneity(df, ["g"], "v", count=True), "g", "distinct_values") == [("b", 2)]


def test_ratio_needs_a_denominator(spark):
    df = spark.createDataFrame([("a", 6.0, 1.0), ("b", 5.0, 1.0), ("c", 9.0, 0.0), ("d", 9.0, None)], "k string, n double, d double")
    assert rows(ops.ratio_threshold(df, F.col("n"), F.col("d"), 5.0), "k") == [("a",)]


def _brute_force(events):
    out = []
    for key, kind, t in events:
        later = [u for k, e, u in events if k == key and e == "end" and u > t]
        if kind == "start" and later:
            out.append((key, t, min(later)))
    return sorted(out, key=str)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["start", "end", "other"]), st.integers(0, 400)), max_size=40))
@example([("a", "start", 62), ("a", "start", 70), ("a", "end", 71)])
def test_pairing_against_brute_force(spark, events):
    events = [(k, kind, at(s)) for k, kind, s in events]
    df = spark.createDataFrame(events, "k string, kind string, ts timestamp_ntz")
    args = (df, ["k"], "ts", F.col("kind") == "start", F.col("kind") == "end", "1 minute")
    want = _brute_force(events)
    assert rows(ops.next_event_pairing(*args), "k", "ts", "end_at") == want
    totals = {}
    for k, a, b in want:
        n, ms = totals.get(k, (0, 0))
        totals[k] = (n + 1, ms + int((b - a).total_seconds() * 1000))
    assert rows(ops.pairing_summary(*args), "k", "pairs", "total_ms") == [(k, *v) for k, v in sorted(totals.items())]


def test_pairing_of_one_hot_moment_and_unmatched(spark):
    # One key and one instant hold nearly all rows; the summary sees that instant once.
    hot = spark.range(20_000).select(F.lit("a").alias("k"), F.lit("start").alias("kind"), F.lit(T0).cast("timestamp_ntz").alias("ts"))
    rest = spark.createDataFrame([("a", "end", at(0)), ("a", "end", at(90)), ("a", "start", at(100))], "k string, kind string, ts timestamp_ntz")
    args = (hot.union(rest), ["k"], "ts", F.col("kind") == "start", F.col("kind") == "end", "1 minute")
    assert rows(ops.pairing_summary(*args), "pairs", "avg_ms") == [(20_000, 90_000.0)]
    unmatched = ops.next_event_pairing(*args, keep_unmatched=True).where("end_at IS NULL")
    assert rows(unmatched, "ts") == [(at(100),)]


def test_log_extract_first_pattern_wins(spark):
    log = spark.createDataFrame([("a", at(0), "BACKUP failed: db x."), ("a", at(0), "nothing"), ("a", at(1), "backup FAILED: db y. BACKUP ok")],
                                "instance_id string, log_date timestamp_ntz, message string")
    out = ops.log_extract(log, [ops.LogPattern("bad", "backup failed", r"db ([a-z]+)\.", ("db",)), ops.LogPattern("good", "backup ok", r"(ok)", ("word",))])
    assert rows(out, "kind", "db") == [("bad", "x"), ("bad", "y")]


def test_privileges_with_exceptions_and_other_instance(spark):
    people = spark.createDataFrame([("a", 1, "sa"), ("a", 2, "##x##"), ("b", 2, "bob")], "instance_id string, id int, name string")
    grants = spark.createDataFrame([("a", 1, "D"), ("a", 2, "G"), ("b", 2, "G"), ("b", 2, "G"), ("b", 9, "G")], "instance_id string, gid int, state string")
    out = ops.privilege_audit(people, grants, [("instance_id", "instance_id"), ("id", "gid")], F.col("state") == "G", F.col("name").startswith("##"))
    assert rows(out, "name") == [("bob",)]


def test_credentials_with_salts(spark):
    logins = spark.createDataFrame([("a", "s1", "joe", ""), ("b", "s2", "joe", "joe"), ("c", "s3", "joe", "password"), ("d", "s4", "joe", "Secret")],
                                   "id string, salt string, name string, word string")
    logins = logins.withColumn("digest", F.upper(F.sha2(F.concat("salt", "word"), 256)))
    out = ops.credential_dictionary_audit(logins, [("blank", ""), ("word", "password")])
    assert rows(out, "id", "weakness") == [("a", "blank"), ("b", "own name"), ("c", "word")]


def test_eligible_databases_by_version_and_edition(spark):
    cols = "instance_id string, database_id long, name string, state int, is_in_standby boolean, source_database_id long"
    dbs = spark.createDataFrame([("old", 1, "master", 0, False, None), ("old", 5, "x", 0, False, None), ("new", 1, "master", 0, False, None),
                                 ("new", 2, "tempdb", 0, False, None), ("new", 5, "X", 0, False, None), ("new", 6, "y", 6, False, None),
                                 ("new", 7, "z", 0, True, None), ("new", 8, "s", 0, False, 5), ("mi", 4, "msdb", 0, False, None), ("mi", 9, "q", 0, False, None)], cols)
    groups = spark.createDataFrame([("new", "x", "g", "G", False), ("mi", "q", "g", "G", True)],
                                   "instance_id string, database_name string, group_id string, group_name string, is_preferred_backup_replica boolean")
    instances = spark.createDataFrame([("old", 10.5, 3), ("new", 16.0, 3), ("mi", 16.0, 8)], "instance_id string, major double, engine_edition int")
    out = ops.eligible_databases(dbs, groups, instances)
    assert rows(out, "instance_id", "database_id", "group_name", "is_preferred_backup_replica") == [
        ("mi", 9, None, None), ("new", 1, None, None), ("new", 5, "G", False), ("old", 5, None, None)]


def test_scope_keeps_nulls_when_unset(spark):
    df = spark.createDataFrame([("Disk", 1, at(0)), (None, 2, at(10)), ("Tape", 3, at(20))], "device string, n int, ts timestamp_ntz")
    assert ops.scope(df, device=None, start=("ts", None)).count() == 3
    assert rows(ops.scope(df, device="disk"), "n") == [(1,)]
    assert rows(ops.scope(df, start=("ts", at(10)), end=("ts", at(19))), "n") == [(2,)]
    assert rows(ops.scope(df, n=[1, 3]), "n") == [(1,), (3,)]


def test_reclassify_first_match(spark):
    df = spark.createDataFrame([(333, "master"), (333, "x"), (335, "msdb")], "check_id int, database_name string")
    system = F.col("database_name").isin("master", "msdb")
    out = ops.reclassify(df, [(333, system, 334), (333, F.lit(True), 399), (335, system, 336)])
    assert rows(out, "check_id") == [(334,), (336,), (399,)]


def test_report_order_levels_and_texts(spark):
    schema = "instance_id string, check_id int, case_no int, database_name string, object_name string, metric double"
    raw = spark.createDataFrame([("b", 601, 0, None, "2016", 12.0), ("a", 203, 0, "x", None, None), ("a", 101, 0, None, "host", None), ("a", 999, 0, None, None, None)], schema)
    texts = [ops.Rule(601, 1, "Update", "{object} at {metric}", "Apply"), ops.Rule(203, 1, "Missing", "{database} has none{object}", "Back up"),
             ops.Rule(101, 0, "Server", "{object}", "")]
    out = ops.report([raw], texts, as_of="2024-06-01 12:00:00")
    assert [(r.check_id, r.issue, r.importance_label, r.captured_on) for r in out.collect()] == [
        (0, "Information captured on 06/01/2024", "Informational", "06/01/2024"), (101, "host", "Informational", "06/01/2024"), (203, "x has none", "High", "06/01/2024"), (601, "2016 at 12", "High", "06/01/2024"),
        (999, "Check 999 has no text", "High", "06/01/2024")]
    assert [r.check_id for r in ops.report([raw], texts, min_importance=1).collect()] == [203, 601, 999]
    assert [r.check_id for r in ops.report([raw], texts, discovery=False).collect()] == [203, 601, 999]
    assert [r.check_id for r in ops.report([raw], texts, order="by_name", discovery=False).collect()] == [999, 203, 601]


@pytest.mark.parametrize("path, device, want", [
    ("S:\\bak\\f.bak", "Disk", "S:\\bak\\"), ("/mnt/b/f", "Disk", "/mnt/b/"), ("{A1}", "Virtual Device", "{Virtual Device}"), ("{A1}", None, "{UNKNOWN}"),
    ("plain", "Disk", None), ("S:\\bak\\", "Disk", None), ("a/b\\c", "Disk", "a/b\\"), ("/x/y\\", "Disk", "/x/")])
def test_parent_location(spark, path, device, want):
    df = spark.createDataFrame([(path, device)], "p string, d string")
    assert df.select(parent_location("p", "d")).first()[0] == want


def test_text_and_number_functions(spark):
    df = spark.createDataFrame([("SELECT 1 FROM t", 14, -1, at(0.0009), at(0.0011))], "t string, s int, e int, a timestamp_ntz, b timestamp_ntz")
    one = df.select(statement_slice("t", "s", "e").alias("x"), quote_name(F.lit("a]b")).alias("q"), millis_between("a", "b").alias("ms"),
                    minutes_between("a", F.lit(at(60)).cast("timestamp_ntz")).alias("m"), percent_of(F.lit(300), F.lit(101695)).alias("p"),
                    percent_of(F.lit(1), F.lit(0)).alias("z")).first()
    assert (one.x, one.q, one.ms, one.m, str(one.p), one.z) == ("1 FROM t", "[a]]b]", 1, 1, "0.29", None)


def test_state_changes_survive_bad_payloads(spark):
    good = ('<event name="x" timestamp="2024-01-01T10:00:00.500Z"><data name="current_state"><value>2</value><text>PRIMARY</text></data>'
            '<data name="availability_group_name"><value>AG1</value></data></event>')
    events = spark.createDataFrame([("a", "availability_replica_state_change", good), ("a", "availability_replica_state_change", "<event"), ("a", "other", good),
                                    ("z", "availability_replica_state_change", good)], "instance_id string, object_name string, event_data string")
    instances = spark.createDataFrame([("a", 330)], "instance_id string, utc_offset_minutes int")
    out = ops.state_changes(events, instances)
    got = {(r.group_name, r.event_time, r.previous_state, r.current_state) for r in out.collect()}
    assert got == {("AG1", datetime(2024, 1, 1, 15, 30, 0, 500000), None, "PRIMARY"), (None, None, None, None)}


def test_union_of_fleets_and_partitioning_change_nothing(spark):
    events = spark.range(500).select((F.col("id") % 7).cast("string").alias("k"), F.when(F.col("id") % 3 == 0, "start").otherwise("end").alias("kind"),
                                     (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 37 % 1000).cast("decimal(18,6)"))).alias("ts"))
    args = (["k"], "ts", F.col("kind") == "start", F.col("kind") == "end")
    whole = rows(ops.next_event_pairing(events, *args), "k", "ts", "end_at")
    parts = [rows(ops.next_event_pairing(events.where(F.col("k") % 2 == p), *args), "k", "ts", "end_at") for p in (0, 1)]
    assert whole == sorted(parts[0] + parts[1], key=str)
    assert whole == rows(ops.next_event_pairing(events.repartition(13), *args), "k", "ts", "end_at")


def test_dictionary_of_any_size(spark):
    """100,000 words against plain Python; small chunks and groups give the same; words, salts and digests may be null."""
    import hashlib

    def digest(salt, word):
        return hashlib.sha256((salt + word).encode()).hexdigest().upper()

    logins = [("blank", "s1", digest("s1", "")), ("word", "s2", digest("s2", "w99999")), ("own", "s3", digest("s3", "own")), ("strong", "s4", digest("s4", "?!")),
              ("twin", "s2", digest("s2", "w99999")), ("twice", "s5", digest("s5", "w7")), ("none", None, digest("", "w1")), ("nothing", "s6", None)]
    df = spark.createDataFrame(logins, "name string, salt string, digest string")
    words = spark.range(100_000).select(F.lit("list").alias("weakness"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    more = spark.createDataFrame([("blank", ""), ("other list", "w7"), ("list", "w7"), ("null", None)], "weakness string, word string")
    want = [("blank", "blank"), ("own", "own name"), ("twice", "list"), ("twice", "other list"), ("twin", "list"), ("word", "list")]
    assert sorted(rows(ops.credential_dictionary_join(df, words.unionByName(more)), "name", "weakness")) == want
    few = words.where("id IN (7, 99999)").unionByName(more)
    assert sorted(rows(ops.credential_dictionary_join(df, few, chunk=1, group=1), "name", "weakness")) == want
    assert rows(ops.credential_dictionary_join(df, few.where("false"), own_name=None), "name", "weakness") == []


def test_log_facts_sort_no_line_but_the_few_of_a_start(spark):
    from helpers import facts, ts

    def line(iid, at, message):
        return dict(instance_id=iid, log_date=ts(at), message=message)

    f = facts(spark, {"instances": [], "error_log": [
        line("a", "2024-06-01 00:00:02", "Copyright (C) two"), line("a", "2024-06-01 00:00:01", "COPYRIGHT (C) one on Windows"), line("a", "2024-06-01 00:00:00", "Login failed for user x"),
        line("a", "2024-06-01 00:00:03", "System Manufacturer: 'M', System Model: 'N'."), line("b", "2024-06-01 00:00:00", "Database Instant File Initialization: enabled."), line("c", "2024-06-01 00:00:00", None)]})
    got = {r.instance_id: (r.version_line, r.maker_line, r.log_file_line, r.failed_logins, r.instant_init) for r in f.log_facts.collect()}
    assert got == {"a": ("COPYRIGHT (C) one on Windows", "System Manufacturer: 'M', System Model: 'N'.", None, 1, False), "b": (None, None, None, 0, True), "c": (None, None, None, 0, None)}
    lines = f.log_facts._jdf.queryExecution().sparkPlan().toString().splitlines()
    for n, text in enumerate(lines):
        if "SortAggregate" in text:
            assert any("Filter" in x and "copyright" in x for x in lines[n:]), text
    assert any("HashAggregate" in x and "count" in x for x in lines)
