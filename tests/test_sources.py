"""Lake layout, snapshots, missing columns and tables, log text, sinks."""
import random

import pytest
from pyspark.sql import functions as F
from helpers import AS_OF, database, instance, table, ts

from fleetaudit.params import AuditParams
from fleetaudit.plans import Facts, audit, security
from fleetaudit.schemas import schema_of
from fleetaudit.sources import Fleet, align, read_event_payloads, read_findings, read_log_text, write_findings, write_snapshot


def test_last_snapshot_per_instance_and_no_later_one(spark, tmp_path):
    root = str(tmp_path)
    for day, name in (("2024-05-20 00:00:00", "old"), ("2024-05-31 00:00:00", "new"), ("2024-06-02 00:00:00", "future")):
        ids = ("a", "b") if name == "old" else ("a",)
        write_snapshot(table(spark, "databases", [database(i, 5, name) for i in ids]).drop("snapshot_ts"), root, "databases", day)
    fleet = Fleet.from_lake(spark, root, AS_OF)
    assert sorted((r.instance_id, r.name) for r in fleet["databases"].collect()) == [("a", "new"), ("b", "old")]
    assert fleet["alerts"].count() == 0 and fleet["alerts"].schema == schema_of("alerts")
    plan = Fleet.from_lake(spark, root, AS_OF)["databases"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan


def test_missing_columns_become_nulls_and_rules_stay_silent(spark):
    narrow = table(spark, "databases", [database("a", 2, "tempdb", is_encrypted=True)]).drop("is_encrypted", "snapshot_ts")
    assert align(narrow, "databases").schema == schema_of("databases")
    assert security.tempdb_encrypted(Facts(Fleet.from_frames(spark, {"databases": narrow}), AuditParams(AS_OF))).count() == 0


def test_log_and_event_files(spark, tmp_path):
    folder = tmp_path / "instance=srv1"
    folder.mkdir()
    (folder / "ERRORLOG").write_text("2024-06-01 10:00:00.120 spid5s      Login failed for user 'x'.\ncontinued line\n2024-06-01 10:00:01.00 Logon       ok\n")
    (folder / "AlwaysOn_health_1.txt").write_text('<event name="availability_replica_state_change" timestamp="2024-06-01T10:00:00Z"/>\n\n')
    log = read_log_text(spark, f"{tmp_path}/*/ERRORLOG*").orderBy("log_date").collect()
    assert [(r.instance_id, r.process_info, r.message) for r in log] == [("srv1", "spid5s", "Login failed for user 'x'.\ncontinued line"), ("srv1", "Logon", "ok")]
    assert not any(r.rejected for r in log)
    assert log[0].log_date == ts("2024-06-01 10:00:00.120")
    events = read_event_payloads(spark, f"{tmp_path}/*/AlwaysOn_health*").collect()
    assert [(r.instance_id, r.object_name) for r in events] == [("srv1", "availability_replica_state_change")]


def test_bad_lines_are_kept_aside(spark, tmp_path):
    folder = tmp_path / "instance=srv1"
    folder.mkdir()
    (folder / "ERRORLOG").write_text("cut off at the start\n2024-13-41 10:00:00.00 spid1 bad date\n2024-06-01 10:00:00.00 Logon Error: 18456\n    Login failed\n")
    (folder / "AlwaysOn_health_1.txt").write_text('<event name="x"><data\n<event name="y"></event>\n')
    log = {r.message: (r.log_date, r.rejected) for r in read_log_text(spark, f"{tmp_path}/*/ERRORLOG*").collect()}
    assert log == {"cut off at the start": (None, True), "bad date": (None, True), "Error: 18456\n    Login failed": (ts("2024-06-01 10:00:00"), False)}
    events = read_event_payloads(spark, f"{tmp_path}/*/AlwaysOn_health*").collect()
    assert sorted((r.object_name, r.rejected) for r in events) == [("x", True), ("y", False)]


@pytest.mark.parametrize("split", [16, 64, 1 << 20])
def test_one_log_file_of_many_splits(spark, tmp_path, split):
    """The same entries whatever the size of a split: continuations over splits, blank lines, lines before the first entry."""
    draw, want, text = random.Random(4), [], "no time yet\n\nnor here\n"
    for n in range(60):
        lines = [f"m{n} " + "x" * draw.randrange(30), *draw.choices(["  at y", "", "z" * 40], k=draw.randrange(4) * (n % 5 == 0) * 3)]
        text += f"2024-06-01 10:{n:02d}:00.00 spid{n}   " + "\n".join(lines) + "\n"
        want.append((ts(f"2024-06-01 10:{n:02d}:00"), f"spid{n}", "\n".join(lines).rstrip()))
    folder = tmp_path / "instance=srv1"
    folder.mkdir()
    (folder / "ERRORLOG").write_text(text)
    (folder / "ERRORLOG.1").write_text("only this\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert split > 64 or spark.read.text(f"{tmp_path}/*/ERRORLOG").rdd.getNumPartitions() > 20
        rows = read_log_text(spark, f"{tmp_path}/*/ERRORLOG*").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.log_date, r.process_info, r.message.rstrip()) for r in rows if not r.rejected) == want
    assert sorted(r.message for r in rows if r.rejected) == ["no time yet", "nor here", "only this"]
    assert {r.instance_id for r in rows} == {"srv1"}


def test_events_of_any_shape(spark, tmp_path):
    folder = tmp_path / "instance=srv1"
    folder.mkdir()
    one, two = '<event name="a" timestamp="t"><data name="d"><value>1</value></data></event>', '<event\n   name="b">\n  <data name="d">\n    <value>&lt;event&gt;</value>\n  </data>\n</event>'
    (folder / "health_1.xel").write_text(f'<RingBufferTarget>\n{one}{two}{one}\n<event name="c"/><event_list/></RingBufferTarget>\n')
    (folder / "health_2.xel").write_text(f'<event name="cut"><data>\n{two}\n<event><data/></event><event name="odd"><data></event>\n<event name="short"><da')
    (folder / "health_3.xel").write_text("nothing here\n")
    rows = [(r.object_name, r.event_data, r.rejected) for r in read_event_payloads(spark, f"{tmp_path}/*/health*").collect()]
    assert sorted(r[:2] for r in rows if not r[2]) == sorted([("a", one), ("a", one), ("b", two), ("b", two), ("c", '<event name="c"/>')])
    assert sorted(r[0] or "" for r in rows if r[2]) == ["", "cut", "odd", "short"]
    assert {r.instance_id for r in read_event_payloads(spark, f"{tmp_path}/*/health*").collect()} == {"srv1"}


def test_lake_keeps_new_columns_narrow_types_and_silent_instances(spark, tmp_path):
    root = str(tmp_path)
    old = table(spark, "databases", [database("a", 2, "tempdb")]).drop("snapshot_ts", "is_encrypted")
    write_snapshot(old, root, "databases", "2023-05-20 00:00:00")
    write_snapshot(table(spark, "databases", [database("b", 2, "tempdb", is_encrypted=True)]).drop("snapshot_ts"), root, "databases", "2024-05-31 00:00:00")
    fleet = Fleet.from_lake(spark, root, AS_OF)
    assert sorted((r.instance_id, r.is_encrypted) for r in fleet["databases"].collect()) == [("a", None), ("b", True)]
    assert [r.instance_id for r in security.tempdb_encrypted(Facts(fleet, AuditParams(AS_OF))).collect()] == ["b"]
    assert [r.instance_id for r in Fleet.from_lake(spark, root, AS_OF, lookback_days=30)["databases"].collect()] == ["b"]
    narrow = table(spark, "instances", [instance("a")]).drop("snapshot_ts").selectExpr("* except (physical_memory_kb)", "cast(physical_memory_kb as int) as physical_memory_kb")
    write_snapshot(narrow, root, "instances", "2024-05-31 00:00:00")
    assert [r.physical_memory_kb for r in Fleet.from_lake(spark, root, AS_OF)["instances"].collect()] == [8192]


def test_findings_history_is_partitioned(spark, tmp_path):
    frames = {"instances": table(spark, "instances", [instance("a")]), "databases": table(spark, "databases", [database("a", 2, "tempdb", is_encrypted=True, create_date=ts("2023-01-01"))])}
    out = audit("tempdb", Fleet.from_frames(spark, frames), AuditParams(AS_OF))
    path = str(tmp_path / "findings")
    write_findings(out, path, AS_OF, "tempdb")
    write_findings(out, path, "2024-06-08 00:00:00", "tempdb")
    write_findings(out, path, AS_OF, "health")
    assert read_findings(spark, path).count() == 3 * out.count()
    assert sorted(r.check_id for r in read_findings(spark, path, "2024-06-05").collect()) == [0, 356, 603]
    assert "PartitionFilters: [isnotnull(snapshot_date" in read_findings(spark, path, "2024-06-05", "tempdb")._jdf.queryExecution().executedPlan().toString()


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    """A retry, one that finds less, and one that finds nothing: each leaves one copy of the run and the others as they are."""
    def run(encrypted: bool):
        frames = {"instances": table(spark, "instances", [instance("a")]), "databases": table(spark, "databases", [database("a", 2, "tempdb", is_encrypted=encrypted)])}
        return audit("tempdb", Fleet.from_frames(spark, frames), AuditParams(AS_OF))

    path = str(tmp_path / "findings")
    write_findings(run(True), path, AS_OF, "tempdb")
    write_findings(run(True), path, AS_OF, "other")
    write_findings(run(True), path, AS_OF, "tempdb")
    assert sorted(r.check_id for r in read_findings(spark, path, run="tempdb").collect()) == [0, 356]
    write_findings(run(False), path, AS_OF, "tempdb")
    kept = read_findings(spark, path, run="tempdb").collect()
    assert [(r.check_id, r.check_name, r.issue, r.instance_id) for r in kept] == [(0, "Fleet audit: tempdb", "Information captured on 06/01/2024", None)]
    assert read_findings(spark, path, run="other").count() == 2


def test_staged_facts_give_the_same_rows(spark):
    from fleetaudit.plans import reports
    from test_checks import backup, media

    tables = {"instances": [instance("a")], "databases": [database("a", 5, "x")], "backup_sets": [backup("a", 1, "x", "D", "2024-05-30 00:00:00")], "backup_media": [media("a", 1)]}
    frames = {n: table(spark, n, rows) for n, rows in tables.items()}
    lazy = reports.backup_detail(Facts(Fleet.from_frames(spark, frames), AuditParams(AS_OF))).collect()
    staged = reports.backup_detail(Facts(Fleet(spark, frames.get, stage=("backup_sets",)), AuditParams(AS_OF, stage_facts=True))).collect()
    assert lazy == staged and len(lazy) == 1


def test_snapshots_resolved_once(spark, tmp_path):
    """The same findings, from about half the scans, and from the folders of last snapshots only."""
    from fleetaudit.plans import findings_of
    from fleetaudit.plans.facts import union

    root = str(tmp_path)
    for day, names in (("2024-05-01 00:00:00", ("a", "b", "c")), ("2024-05-20 00:00:00", ("a", "b")), ("2024-05-31 00:00:00", ("a",))):
        rows = {"instances": [instance(i) for i in names], "databases": [database(i, n, f"d{n}", is_auto_shrink_on=True, compatibility_level=100) for i in names for n in (5, 6)],
                "configurations": [dict(instance_id=i, name="priority boost", value=1, value_in_use=1) for i in names]}
        for name, r in rows.items():
            write_snapshot(table(spark, name, r).drop("snapshot_ts"), root, name, day)
    found, scans = [], []
    for once in (False, True):
        fleet = Fleet.from_lake(spark, root, AS_OF, resolve_once=once)
        out = union(*findings_of("health", Facts(fleet, AuditParams(AS_OF))))
        found.append(sorted((tuple(r) for r in out.collect()), key=str))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("Relation ["))
    assert found[0] == found[1] and {r[0] for r in found[0]} == {"a", "b", "c"}
    assert 5 * scans[1] <= 3 * scans[0], scans  # about one scan for two
    read = Fleet.from_lake(spark, root, "2024-05-25 00:00:00", resolve_once=True)._read("databases")
    assert {r.instance_id for r in read.collect()} == {"a", "b", "c"}
    assert {r[0].split("snapshot_date=")[1][:10] for r in read.select(F.input_file_name()).collect()} == {"2024-05-20", "2024-05-01"}
