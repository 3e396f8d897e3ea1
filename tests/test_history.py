"""History by event date: what is pruned, what is found; the greatest row of a group without sorting."""
import random
import re

import pytest
from helpers import AS_OF, database, facts, instance, table, ts
from pyspark.sql import functions as F
from test_checks import backup, media
from test_plans import plan

from fleetaudit import operators as ops
from fleetaudit.params import AuditParams
from fleetaudit.plans import Facts, recoverability, reports
from fleetaudit.sources import Fleet, in_range, write_backup_history, write_history, write_snapshot

STARTS = ["2024-05-01 10:00:00", "2024-05-26 00:00:00", "2024-05-28 23:59:59", "2024-05-31 00:00:00", "2024-06-01 12:00:00", "2024-06-01 12:00:01", None]


def explain(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def pruned(df, folder: str) -> bool:
    """Every scan of backup sets and media has both bounds of the range among its partition filters."""
    scans = re.findall(r"/(backup_sets|backup_media)\], PartitionFilters: \[([^\]]*)\]", explain(df))
    return {t for t, _ in scans} == {"backup_sets", "backup_media"} and all(folder in p and ">=" in p and "<=" in p for _, p in scans)


def sets_and_media(spark):
    sets = [dict(backup("a", i, "x", "D", start or AS_OF, has_backup_checksums=False), backup_start_date=start and ts(start)) for i, start in enumerate(STARTS, 1)]
    return table(spark, "backup_sets", sets), table(spark, "backup_media", [media("a", i) for i in range(1, len(STARTS) + 1)])


@pytest.fixture(params=["day", "month"])
def lake(spark, tmp_path, request):
    """Backups of a month in two shipments; the second holds rows of days the first has written."""
    root, (sets, files) = str(tmp_path), sets_and_media(spark)
    write_snapshot(table(spark, "instances", [instance("a")]).drop("snapshot_ts"), root, "instances", AS_OF)
    write_snapshot(table(spark, "databases", [database("a", 5, "x")]).drop("snapshot_ts"), root, "databases", AS_OF)
    for n, shipped_at in ((1, "2024-06-01 13:00:00"), (0, "2024-06-08 00:00:00")):
        write_backup_history(sets.where(F.col("backup_set_id") % 2 == n), files.where(F.col("media_set_id") % 2 == n), root, shipped_at, unit=request.param)
    return root, "event_date" if request.param == "day" else "event_month"


def test_range_prunes_folders_and_finds_late_rows(spark, lake):
    root, folder = lake
    f = Facts(Fleet.from_lake(spark, root, AS_OF), AuditParams(AS_OF))
    detail = reports.backup_detail(f)
    assert pruned(detail, folder)
    assert sorted(r.backup_set_id for r in detail.collect()) == [2, 3, 4, 5]
    rules = recoverability.history_rules(f)
    assert pruned(rules, folder)
    assert [(r.check_id, r.metric) for r in rules.collect()] == [(202, 4.0)]


def test_range_reads_the_folders_of_its_days_only(spark, lake):
    root, folder = lake
    fleet = Fleet.from_lake(spark, root, AS_OF)
    with_files = in_range(spark.read.parquet(f"{root}/backup_sets"), "backup_sets", "2024-05-30 00:00:00", AS_OF)
    read = {re.search(rf"{folder}=([^/]*)/", r[0]).group(1) for r in with_files.select(F.input_file_name()).collect()}
    assert read == ({"2024-05-31", "2024-06-01"} if folder == "event_date" else {"2024-05-01", "2024-06-01"})
    assert fleet.between("backup_sets").count() == len(STARTS)  # no bound: rows without a time too
    assert fleet["backup_sets"].count() == len(STARTS)


def test_same_rows_from_frames_and_both_layouts(spark, tmp_path, lake):
    sets, files = sets_and_media(spark)
    old = str(tmp_path / "old")
    for name, rows in (("backup_sets", sets), ("backup_media", files)):
        write_snapshot(rows.where("true").drop("snapshot_ts"), old, name, "2024-06-02 00:00:00")
    for name in ("instances", "databases"):
        write_snapshot(Fleet.from_lake(spark, lake[0], AS_OF)[name].drop("snapshot_ts"), old, name, AS_OF)
    frames = {"instances": table(spark, "instances", [instance("a")]), "databases": table(spark, "databases", [database("a", 5, "x")]), "backup_sets": sets, "backup_media": files}
    fleets = [Fleet.from_lake(spark, lake[0], AS_OF), Fleet.from_lake(spark, old, AS_OF), Fleet.from_frames(spark, frames), Fleet(spark, frames.get, stage=("backup_sets", "backup_media"))]
    got = [[tuple(r) for r in reports.backup_detail(Facts(x, AuditParams(AS_OF))).collect()] for x in fleets]
    assert len(got[0]) == 4 and all(g == got[0] for g in got)
    assert "PartitionFilters: [isnull(snapshot_date" in explain(fleets[1].between("backup_sets", "2024-05-31 00:00:00")) or \
        "snapshot_date" in explain(fleets[1].between("backup_sets", "2024-05-31 00:00:00"))


def test_media_reused_by_sets_of_several_days(spark, tmp_path):
    root = str(tmp_path)
    sets = table(spark, "backup_sets", [backup("a", 1, "x", "D", "2024-05-01 00:00:00"), dict(backup("a", 2, "x", "D", "2024-05-31 00:00:00"), media_set_id=1),
                                        dict(backup("a", 3, "x", "D", "2024-05-31 01:00:00"), media_set_id=1)])
    write_snapshot(table(spark, "instances", [instance("a")]).drop("snapshot_ts"), root, "instances", AS_OF)
    write_snapshot(table(spark, "databases", [database("a", 5, "x")]).drop("snapshot_ts"), root, "databases", AS_OF)
    write_backup_history(sets, table(spark, "backup_media", [media("a", 1), media("a", 9)]), root, AS_OF)
    fleet = Fleet.from_lake(spark, root, AS_OF)
    assert sorted(r.backup_set_id for r in reports.backup_detail(Facts(fleet, AuditParams(AS_OF))).collect()) == [2, 3]
    assert fleet["backup_media"].where("media_set_id = 9").count() == 1  # no set: kept, without a day


def test_other_history_in_range(spark, tmp_path):
    root = str(tmp_path)
    rows = [dict(instance_id="a", log_date=ts(t), message=m) for t, m in (("2024-05-01 00:00:00", "old"), ("2024-05-31 00:00:00", "new"))]
    write_history(table(spark, "error_log", rows), root, "error_log", AS_OF)
    fleet = Fleet.from_lake(spark, root, AS_OF)
    assert [r.message for r in fleet.between("error_log", "2024-05-20 00:00:00", AS_OF).collect()] == ["new"]
    assert fleet.between("error_log", None, "2024-05-20 00:00:00").count() == 1
    assert fleet.between("restore_history", "2024-05-20 00:00:00").count() == 0  # not collected


# Greatest row of a group

def test_of_greatest_against_plain_python(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.choice(["D", "L", None, "X"]), draw.choice([None, 1, 2, 3, 4]), n) for n in range(200)]
    rows += [("only null", "D", None, 900), ("only null", "D", None, 901)]
    df = spark.createDataFrame(rows, "k string, kind string, at long, n long").repartition(5)
    want = []
    for k, kind, at, n in rows:
        group = [r[2] for r in rows if r[:2] == (k, kind) and r[2] is not None]
        if at == (max(group) if group else None):
            want.append((k, kind, at, n))
    assert sorted((tuple(r) for r in ops.of_greatest(df, ["k", "kind"], "at").collect()), key=str) == sorted(want, key=str)


def test_last_by_type_keeps_keys_whose_order_is_unknown(spark):
    df = spark.createDataFrame([("a", "D", 1, "x"), ("a", "D", 2, "y"), ("a", "L", None, "z"), ("b", "L", None, "q"), ("c", "Z", 1, "r")], "k string, kind string, at long, v string")
    out = ops.last_by_type_wide(df, ["k"], "kind", {"D": "full", "L": "log"}, "at", ["v"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", "y", None), ("b", None, None)]


def test_latest_per_key_breaks_ties_by_the_later_columns(spark):
    df = spark.createDataFrame([("a", 2, "u"), ("a", 2, "v"), ("a", 1, "z"), (None, 5, "n"), ("d", None, "p"), ("d", None, "q")], "k string, at long, who string")
    out = ops.latest_per_key(df, ["k"], ["at", "who"], ["at", "who"])
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([("a", 2, "v"), (None, 5, "n"), ("d", None, "q")], key=str)


@pytest.mark.parametrize("name", ["o25_last_by_type", "o26_last_restore", "report_backup_summary", "report_last_restore"])
def test_raw_history_is_not_sorted_by_aggregates(spark, name):
    """Every sorting aggregate stands above the semi join that has thinned the history."""
    lines = plan(spark, name).splitlines()
    depth = [len(re.match(r"[\s:+|*()\d-]*", line).group()) for line in lines]
    for n, line in enumerate(lines):
        if "SortAggregate" in line:
            end = next((m for m in range(n + 1, len(lines)) if depth[m] <= depth[n]), len(lines))
            assert any("LeftSemi" in x for x in lines[n + 1:end]), line
