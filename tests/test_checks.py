"""Checks on hand-written fleets: one row that fires, one on the limit, one inside, one null, and the
same key on a second instance that must not fire."""
from decimal import Decimal

from helpers import database, facts, hits, instance, ts

from fleetaudit.plans import audit, availability, discovery, integrity, performance, recoverability, reliability, reports, security
from fleetaudit.plans.facts import union
from fleetaudit.sources import Fleet


def backup(iid, set_id, db, kind, start, **kw):
    return dict(dict(instance_id=iid, backup_set_id=set_id, server_name=iid, database_name=db, type=kind, recovery_model="FULL", is_copy_only=False,
                     is_password_protected=False, has_backup_checksums=True, backup_start_date=ts(start), backup_finish_date=ts(start),
                     backup_size=Decimal(3 * 1048576), compressed_backup_size=Decimal(1048576), media_set_id=set_id), **kw)


def media(iid, set_id, seq=1, path="S:\\b\\f.bak", device=2):
    return dict(instance_id=iid, media_set_id=set_id, family_sequence_number=seq, physical_device_name=path, device_type=device)


def test_coverage_limits(spark):
    f = facts(spark, {
        "instances": [instance("a"), instance("b")],
        "databases": [database("a", 5, "Never"), database("a", 6, "OnLimit"), database("a", 7, "Inside"), database("a", 8, "simple", recovery_model_desc="SIMPLE"),
                      database("a", 9, "away", state=6), database("a", 2, "tempdb"), database("b", 5, "never"), database("a", 10, "secondary")],
        "ag_membership": [dict(instance_id="a", database_name="SECONDARY", group_id="g", group_name="G", is_preferred_backup_replica=False)],
        "backup_sets": [backup("a", 1, "onlimit", "D", "2024-05-25 12:00:00"), backup("a", 2, "INSIDE", "D", "2024-05-25 12:00:01"),
                        backup("a", 3, "onlimit", "L", "2024-05-31 12:00:00"), backup("a", 4, "inside", "L", "2024-05-31 12:00:01"),
                        backup("a", 5, "simple", "D", "2024-06-01 11:59:30"), backup("a", 6, "never", "D", "2024-06-01 00:00:00", backup_finish_date=None),
                        backup("a", 7, "never", "D", "2024-06-01 00:00:00", server_name="other"), backup("b", 8, "never", "D", "2024-06-01 00:00:00", server_name=None),
                        backup("b", 9, "never", "L", "2024-06-01 11:00:00")],
    }, objective_minutes=60)
    assert hits(recoverability.coverage(f), "database_name", "metric") == sorted([
        ("a", 203, 0, "Never", None), ("a", 204, 0, "Never", None), ("a", 205, 0, "OnLimit", None), ("a", 206, 0, "OnLimit", None),
        ("a", 214, 0, "Inside", 1440.0), ("a", 214, 0, "OnLimit", 1440.0), ("a", 214, 1, "Never", None), ("a", 214, 1, "secondary", None)], key=str)


def test_history_rules_and_chain(spark):
    f = facts(spark, {
        "instances": [instance("a"), instance("old", product_version="10.50.4000.0"), instance("eleven", product_version="11.0.7000.0")],
        "databases": [database("a", 5, "x"), database("a", 6, "y"), database("old", 5, "x"), database("eleven", 5, "x")],
        "backup_sets": [backup("a", 1, "x", "D", "2024-05-30 00:00:00", has_backup_checksums=False), backup("a", 2, "x", "D", "2024-05-31 00:00:00"),
                        backup("a", 3, "y", "L", "2024-05-30 00:00:00"), backup("a", 4, "y", "L", "2024-05-30 06:00:00", is_copy_only=True),
                        backup("a", 5, "x", "D", "2024-05-25 11:59:59", has_backup_checksums=False), backup("a", 9, "dropped", "D", "2024-05-30 00:00:00"),
                        backup("old", 1, "x", "D", "2024-05-30 00:00:00", is_password_protected=True, has_backup_checksums=False),
                        backup("eleven", 1, "x", "D", "2024-05-30 00:00:00", is_password_protected=True, has_backup_checksums=False)],
        "backup_media": [media("a", 1), media("a", 1, 2), media("a", 2, path="T:\\b\\f.bak"), media("a", 3, path=" nul "), media("a", 4, path="NUL:"), media("a", 5), media("a", 9),
                         media("old", 1), media("eleven", 1)],
    })
    assert hits(union(recoverability.history_rules(f), recoverability.split_chains(f)), "database_name", "object_name", "metric") == sorted([
        ("a", 201, 0, "x", "Full", 2.0), ("a", 202, 0, "x", None, 2.0), ("a", 218, 0, "y", "2024-05-30 00:00:00", 1.0), ("old", 215, 0, "x", None, None)], key=str)
    detail = {(r.backup_set_id, r.family_sequence_number): (r.size_mb, str(r.compression_percent)) for r in reports.backup_detail(f).where("instance_id = 'a'").collect()}
    assert detail[(1, 1)] == (1, "66.67") and detail[(2, 1)] == (3, "66.67") and (5, 1) not in detail
    summary = {r.database_name: r for r in reports.backup_summary(f).where("instance_id = 'a'").collect()}
    assert (summary["x"].last_full_path, summary["x"].last_full_number_of_files, summary["x"].minutes_since_last_backup) == ("T:\\b\\", 1, 2160)
    assert (summary["y"].last_log_start, summary["y"].last_log_path) == (ts("2024-05-30 06:00:00"), None)


def test_certificates(spark):
    def cert(n, saved):
        return dict(instance_id="a", name=f"c{n}", thumbprint=f"T{n}", pvt_key_last_backup_date=saved and ts(saved), expiry_date=ts("2024-06-11 00:00:00"))

    f = facts(spark, {
        "instances": [instance("a"), instance("old", product_version="11.0.7000.0")],
        "certificates": [cert(1, None), cert(2, "2024-03-03 12:00:00"), cert(3, "2024-03-03 12:00:01"), dict(cert(1, None), instance_id="old")],
        "backup_sets": [backup(i, n, f"db{n}", "D", "2020-01-01 00:00:00", encryptor_thumbprint=f"T{n}") for i in ("a", "old") for n in (1, 2, 3)] * 2,
    }, certificate_within_days=9)
    assert hits(recoverability.certificates(f), "database_name", "object_name") == [("a", 210, 0, "db1", "c1"), ("a", 210, 1, "db2", "c2")]


def test_failed_backups_parse_names(spark):
    def line(text, at="2024-06-01 00:00:00"):
        return dict(instance_id="a", log_date=ts(at), message=text)

    text = "BACKUP failed to complete the command BACKUP "
    f = facts(spark, {"error_log": [line(text + "DATABASE [My Db]. Check."), line(text + "DATABASE [My Db]. Check."), line(text + "LOG x. Check."),
                                    line(text + "CERTIFICATE x. Check."), line(text + "DATABASE . Check."), line(text + "LOG old. Check.", "2024-05-01 00:00:00")]})
    assert hits(recoverability.failed_backups(f, True), "database_name") == [("a", 207, 0, "My Db"), ("a", 207, 0, "x")]
    assert ("a", 207, 0, "old") in hits(recoverability.failed_backups(f, False), "database_name")


def principal(iid, n, name, sid, kind="S", **kw):
    return dict(dict(instance_id=iid, principal_id=n, name=name, sid=sid, type=kind, is_disabled=False, deny_login=False), **kw)


def test_owners_are_three_valued(spark):
    f = facts(spark, {
        "instances": [instance("a"), instance("b")],
        "server_principals": [principal("a", 1, "sa", "0x01"), principal("a", 2, "Boss", "0x02"), principal("a", 3, "CORP\\u", "0x03", "U"), principal("b", 9, "x", "0x09")],
        "server_role_members": [dict(instance_id="a", role_name="sysadmin", member_name="BOSS")],
        "databases": [database("a", 5, "boss", owner_sid="0x02", is_trustworthy_on=True), database("a", 6, "plain", owner_sid="0x03", is_trustworthy_on=True),
                      database("a", 7, "gone", owner_sid="0x09", is_trustworthy_on=True), database("a", 8, "null", owner_sid=None),
                      database("a", 9, "snap", owner_sid="0x09", source_database_id=5), database("b", 5, "fine", owner_sid="0x09")],
    }, preferred_owner="SA")
    assert hits(security.owners(f), "database_name") == sorted([
        ("a", 305, 0, "gone"), ("a", 305, 0, "null"), ("a", 308, 0, "boss"), ("a", 328, 0, "boss"), ("a", 332, 0, "plain"), ("a", 346, 0, "plain"),
        ("a", 327, 0, "boss"), ("a", 327, 0, "plain"), ("b", 327, 0, "fine")], key=str)
    assert ("a", 305, 0, "snap") in hits(security.owners(f, unknown_snapshots=True), "database_name")


def test_database_roles_and_users(spark):
    def user(n, name, kind="S", sid="0x08", auth="INSTANCE", db="x"):
        return dict(instance_id="a", database_name=db, principal_id=n, name=name, type=kind, sid=sid, authentication_type_desc=auth)

    def member(role, who, db="x"):
        return dict(instance_id="a", database_name=db, role_principal_id=role, member_principal_id=who)

    people = [user(1, "dbo"), user(2, "guest", sid="0x00"), user(5, "joe"), user(6, "lost", sid="0xDEAD"), user(7, "app", "R", None), user(8, "RSExecRole", "R", None),
              user(9, "long", sid="0x" + "AB" * 29), user(10, "own", sid="0xBEEF", auth="DATABASE"), user(11, "null", sid=None), user(16384, "db_owner", "R", None)]
    f = facts(spark, {
        "instances": [instance("a")], "databases": [database("a", 5, "X"), database("a", 4, "msdb")], "server_principals": [principal("a", 8, "joe", "0x08")],
        "db_principals": people + [dict(p, database_name="msdb") for p in people],
        "db_role_members": [member(16384, 1), member(16384, 5), member(16384, 7), member(16384, 8), member(16384, 5, "msdb")],
    })
    assert hits(security.database_roles(f), "database_name", "object_name") == sorted([
        ("a", 333, 0, "X", "joe in db_owner"), ("a", 333, 0, "X", "app in db_owner"), ("a", 333, 0, "X", "RSExecRole in db_owner"), ("a", 334, 0, "msdb", "joe in db_owner"),
        ("a", 337, 0, "X", "app in db_owner")], key=str)
    assert hits(security.orphaned_users(f), "database_name", "object_name") == [("a", 338, 0, "X", "lost"), ("a", 338, 0, "msdb", "lost")]


def test_linked_servers_six_cases(spark):
    def login(n, local, own, remote):
        return dict(instance_id="a", server_id=n, local_principal_id=local, uses_self_credential=own, remote_name=remote)

    f = facts(spark, {
        "linked_servers": [dict(instance_id="a", server_id=n, name=f"L{n}", data_source="s", product=None, provider="P", is_linked=n != 9) for n in (1, 2, 3, 4, 5, 6, 9)],
        "linked_logins": [login(1, 0, False, "SA"), login(2, 0, False, "r"), login(3, 0, True, None), login(4, 0, False, None), login(5, 2, False, "r"), login(6, 2, True, None),
                          login(6, 77, True, None), login(9, 0, False, "sa")],
        "server_principals": [principal("a", 2, "joe", "0x02")],
    })
    assert hits(security.linked_servers(f), "object_name") == [
        ("a", 323, 0, "L1 s P SA"), ("a", 324, 0, "L2 s P r"), ("a", 325, 0, "L3 s P"), ("a", 325, 1, "L4 s P"), ("a", 325, 2, "L5 s P joe r"), ("a", 325, 3, "L6 s P joe")]


def test_replica_checks(spark):
    def replica(n, **kw):
        return dict(dict(instance_id="a", group_id="g", replica_id=f"r{n}", group_name="AG", server_instance=f"HOST{n}\\I", is_local=n == 1, availability_mode_desc="SYNCHRONOUS_COMMIT",
                         failover_mode_desc="AUTOMATIC", seeding_mode=1, session_timeout=15, connected_state_desc="CONNECTED"), **kw)

    def db(n, name, **kw):
        return dict(dict(instance_id="a", group_id="g", replica_id=f"r{n}", group_name="AG", database_name=name, synchronization_state_desc="SYNCHRONIZED", is_local=True,
                         is_primary_replica=True, is_database_joined=True, is_suspended=False, is_failover_ready=True, secondary_lag_seconds=5), **kw)

    f = facts(spark, {
        "instances": [instance("a", cluster_name="C")], "server_principals": [principal("a", 1, "sa", "0x01"), principal("a", 2, "joe", "0x02")],
        "ag_groups": [dict(instance_id="a", group_id="g", group_name="AG", owner_sid="0x02", backup_preference_desc="primary", health_check_timeout=30001, cluster_type=2, db_failover=True)],
        "ag_replicas": [replica(1, session_timeout=10), replica(2, session_timeout=9, failover_mode_desc="MANUAL"), replica(3, session_timeout=11, connected_state_desc="DISCONNECTED", seeding_mode=0)],
        "ag_databases": [db(1, "ok"), db(1, "lag", secondary_lag_seconds=6), db(2, "unready", is_failover_ready=None), db(1, "behind", synchronization_state_desc=None),
                         db(3, "unjoined", is_database_joined=None, is_failover_ready=False), db(1, "paused", is_suspended=True)],
        "cluster_members": [dict(instance_id="a", member_name=f"host{n}", member_type_desc="CLUSTER_NODE", member_state_desc="UP" if n < 3 else "DOWN", number_of_quorum_votes=1) for n in (1, 2, 3)],
        "ag_listeners": [dict(instance_id="a", group_id="g", group_name="AG", dns_name=d, ip_address=i, ip_state=s) for d, i, s in (("l1", "1", "ONLINE"), ("l1", "2", "OFFLINE"), ("l2", "3", "OFFLINE"))],
    })
    found = hits(union(availability.groups(f), availability.replicas(f), availability.replica_databases(f), availability.quorum(f), availability.mixed_modes(f), availability.listeners(f)),
                 "database_name", "object_name")
    assert found == sorted([
        ("a", 407, 0, None, "AG joe"), ("a", 408, 0, None, "C"), ("a", 410, 0, None, "host3"), ("a", 412, 0, None, "AG"), ("a", 413, 0, "unjoined", "AG"), ("a", 414, 0, "paused", "AG"),
        ("a", 415, 0, None, "AG HOST1\\I"), ("a", 415, 1, None, "AG HOST2\\I"), ("a", 417, 0, None, "l2 3 OFFLINE"), ("a", 418, 0, None, "AG HOST3\\I"), ("a", 421, 0, "unjoined", "AG HOST3\\I"),
        ("a", 423, 0, "lag", "AG HOST1\\I"), ("a", 427, 0, None, "AG"), ("a", 430, 0, "behind", "AG HOST1\\I NOT SYNCHRONIZING"), ("a", 431, 0, None, "AG HOST3\\I")], key=str)
    assert reports.groups(f).first().cluster_type == "External"


def test_endpoint_rights(spark):
    def service(iid, account):
        return dict(instance_id=iid, servicename="SQL Server (MSSQLSERVER)", service_account=account, status_desc="Running")

    names = ["told", "no", "grant", "sys", "unknown", "noendpoint"]
    f = facts(spark, {
        "instances": [instance(n, can_connect_endpoint={"told": "Yes", "no": "No"}.get(n)) for n in names],
        "ag_groups": [dict(instance_id=n, group_id="g", group_name="G") for n in names], "server_services": [service(n, "CORP\\svc") for n in names],
        "server_principals": [principal(n, 4, "corp\\SVC", "0x04", "U") for n in names if n != "unknown"],
        "endpoints": [dict(instance_id=n, endpoint_id=7, name="e", principal_id=4, type=4, state_desc="STARTED") for n in names if n != "noendpoint"],
        "server_permissions": [dict(instance_id="grant", grantee_principal_id=4, **{"class": 105}, major_id=7, permission_name="CONNECT", state="W"),
                               dict(instance_id="noendpoint", grantee_principal_id=4, **{"class": 105}, major_id=7, permission_name="CONNECT", state="G")],
        "server_role_members": [dict(instance_id="sys", role_name="sysadmin", member_name="corp\\svc")],
    })
    got = {r.instance_id: (r.can_connect, r.is_sysadmin) for r in availability.endpoint_rights(f).collect()}
    assert got == {"told": ("Yes", "No"), "no": ("No", "No"), "grant": ("Yes", "No"), "sys": ("Yes", "Yes"), "unknown": ("Unknown", "No"), "noendpoint": ("Unknown", "No")}
    assert hits(availability.endpoint_access(f)) == [("no", 432, 0)]


def test_integrity_limits(spark):
    def known_good(db, value):
        return dict(instance_id="a", database_name=db, field="dbi_dbccLastKnownGood", value=value)

    f = facts(spark, {
        "instances": [instance("a"), instance("web", engine_edition=4), instance("blind", collected_as_sysadmin=False)],
        "databases": [database("a", 5, "old"), database("a", 6, "limit"), database("a", 7, "ro", is_read_only=True, updateability="READ_ONLY"), database("a", 8, "bad"), database("a", 2, "tempdb")],
        "db_info": [known_good("OLD", "2024-05-18 11:59:59.999"), known_good("old", "2024-05-18 11:59:59.999"), known_good("limit", "2024-05-18 12:00:00.000"), known_good("ro", "1900-01-01 00:00:00.000"),
                    known_good("bad", "never"), known_good("tempdb", "1900-01-01 00:00:00.000")],
        "alerts": [dict(instance_id="a", name=f"s{n}", severity=n, message_id=0, enabled=n != 20) for n in range(19, 25)] + [dict(instance_id="a", name="m", severity=0, message_id=n, enabled=True) for n in (823, 825)],
        "suspect_pages": [dict(instance_id="a", database_id=5, event_type=t, error_count=2, last_update_date=ts(at)) for t, at in ((1, "2024-05-02 12:00:00"), (5, "2024-05-02 11:59:59"))],
    })
    assert hits(union(*integrity.health_profile(f)), "database_name", "object_name") == sorted([
        ("a", 503, 0, "old", "2024-05-18"), ("a", 502, 0, None, "severity 25"), ("a", 502, 0, None, "message 824"), ("a", 505, 0, None, "s20"),
        ("a", 504, 0, "old", "2024-05-02 12:00:00")], key=str)


def file(iid, db, n, **kw):
    return dict(dict(instance_id=iid, database_id=db, file_id=n, type=0, type_desc="ROWS", name=f"f{n}", physical_name=f"D:\\f{n}", size=2048, max_size=-1, growth=8192,
                     is_percent_growth=False, data_space_id=1, space_used=1024), **kw)


LOG = dict(type=1, type_desc="LOG", data_space_id=0)


def test_files(spark):
    drives = [dict(instance_id="a", drive=d, total_mb=Decimal(1000), free_mb=Decimal(m)) for d, m in (("C", 100), ("D", 99), ("E", 500))] + [dict(instance_id="b", drive="C", total_mb=Decimal(0), free_mb=Decimal(0))]
    f = facts(spark, {
        "instances": [instance("a", cpu_count=4), instance("b", cpu_count=16, service_tier="GeneralPurpose")], "drives": drives,
        "databases": [database("a", 5, "u"), database("b", 5, "u"), database("a", 2, "tempdb"), database("b", 2, "tempdb")],
        "files": [file("a", 5, 1, physical_name="c:\\f1", growth=0), file("a", 5, 2, physical_name="D:\\f2", max_size=268435455), file("a", 5, 3, physical_name="D:\\l", size=12801, **LOG),
                  file("a", 5, 4, growth=8191, max_size=268435456), file("b", 5, 1, physical_name="C:\\f1", name="master"), file("b", 5, 2, size=12800, **LOG),
                  file("a", 2, 1), file("a", 2, 2, size=1024, growth=0), file("a", 2, 3, is_percent_growth=True, growth=10, space_used=None), file("a", 2, 4, size=9000, max_size=15597568, space_used=4501, **LOG),
                  *[file("b", 2, n, physical_name="T:\\t") for n in range(1, 9)], file("b", 2, 9, max_size=15597567, **LOG)],
        "io_stats": [dict(instance_id="a", database_id=2, file_id=1, num_of_reads=10, num_of_writes=0, io_stall_read_ms=1019, io_stall_write_ms=999999),
                     dict(instance_id="a", database_id=2, file_id=2, num_of_reads=10, num_of_writes=1, io_stall_read_ms=1009, io_stall_write_ms=101),
                     dict(instance_id="a", database_id=5, file_id=1, num_of_reads=1, num_of_writes=1, io_stall_read_ms=5000, io_stall_write_ms=5000)],
    })
    assert hits(union(reliability.files(f), reliability.shared_drives(f)), "database_name", "object_name") == sorted([
        ("a", 605, 0, "tempdb", "f2"), ("a", 606, 0, "u", "f1"), ("a", 607, 0, "u", "f1"), ("a", 620, 0, "u", "f2"), ("b", 630, 0, "u", "master"), ("a", 608, 0, "u", None)], key=str)
    assert hits(reliability.tempdb_files(f), "object_name") == [("a", 605, 0, "f2"), ("a", 619, 0, "f4"), ("b", 619, 0, "f9")]
    assert hits(reliability.drive_space(f), "object_name") == [("a", 618, 0, "D")]
    assert hits(performance.tempdb_layout(f, True), "metric") == sorted([
        ("a", 707, 0, 3.0), ("a", 708, 0, None), ("a", 709, 0, None), ("a", 710, 0, None)], key=str)
    assert hits(performance.tempdb_files(f), "object_name") == sorted([("a", 711, 0, "f3"), ("a", 714, 0, "f2"), ("a", 714, 0, "f4")], key=str)
    assert hits(performance.tempdb_stalls(f), "object_name", "metric") == [("a", 718, 0, "f1", 101.0), ("a", 719, 0, "f2", 101.0)]
    assert hits(performance.files(f), "database_name", "object_name") == sorted([("a", 720, 0, "u", None), ("a", 722, 0, "u", "f4")], key=str)


def test_versions(spark):
    versions = {"old": "12.0.9999.1", "behind": "16.0.4261.1", "patched": "16.0.4262.0", "r2": "10.50.6000.1", "strange": "9.0.1.1", "null": None}
    f = facts(spark, {"instances": [instance(k, product_version=v) for k, v in versions.items()] + [instance("mi", product_version="12.0.1.1", engine_edition=8)]})
    assert hits(reliability.versions(f), "object_name") == [("behind", 601, 0, "2022"), ("old", 602, 0, "2014"), ("r2", 602, 0, "2008 R2")]


def test_jobs(spark):
    f = facts(spark, {
        "jobs": [dict(instance_id="a", job_id=n, name=f"j{n}", enabled=n != 4, owner_sid=s) for n, s in ((1, "0x01"), (2, "0x02"), (3, "0x09"), (4, "0x02"), (5, "0x05"))],
        "job_schedules": [dict(instance_id="a", job_id=1, schedule_id=1), dict(instance_id="a", job_id=2, schedule_id=2), dict(instance_id="a", job_id=3, schedule_id=99), dict(instance_id="a", job_id=5, schedule_id=1)],
        "schedules": [dict(instance_id="a", schedule_id=1, name="on", enabled=True), dict(instance_id="a", schedule_id=2, name="off", enabled=False)],
        "server_principals": [principal("a", 1, "sa", "0x01"), principal("a", 2, "joe", "0x02"), principal("a", 5, "##MS##", "0x05")],
    })
    assert hits(reliability.jobs(f), "object_name") == [("a", 609, 0, "j2 off"), ("a", 610, 0, "j3"), ("a", 611, 0, "j2 joe")]


def test_power_plan_and_file_initialization(spark):
    fast, slow = "8C5E7FDA-E8BF-4A96-9A85-A6E23A8C635C", "381b4222-f694-41f0-9685-ff5bb260df2e"

    def key(iid, name, value):
        return dict(instance_id=iid, key=name, value=value)

    def engine(iid, flag):
        return dict(instance_id=iid, servicename="SQL Server (X)", service_account="s", instant_file_initialization_enabled=flag)

    f = facts(spark, {
        "instances": [instance(i) for i in "abc"] + [instance("blind", collected_as_sysadmin=False)],
        "registry_settings": [key("a", "PolicyPowerScheme", fast), key("a", "LocalPowerScheme", slow), key("b", "LocalPowerScheme", slow), key("c", "LocalPowerScheme", "x"), key("blind", "LocalPowerScheme", slow)],
        "server_services": [engine("a", "N"), engine("b", None), engine("c", None), engine("blind", None)],
        "error_log": [dict(instance_id="b", log_date=ts("2024-01-01"), message="other"), dict(instance_id="c", log_date=ts("2024-01-01"), message="Database Instant File Initialization: enabled. x")],
    })
    assert hits(performance.power_plan(f), "object_name") == [("b", 724, 0, "balanced power"), ("c", 724, 0, "an unknown power mode")]
    assert hits(performance.instant_initialization(f)) == [("a", 725, 0), ("b", 725, 0)]


def test_freezes_keep_names_with_periods(spark):
    def line(at, text, iid="a"):
        return dict(instance_id=iid, log_date=ts(f"2024-06-01 {at}"), message=text)

    f = facts(spark, {"error_log": [
        line("00:00:00", "I/O is frozen on database my.db. No user action"), line("00:00:01", "I/O is frozen on database my.db. No user action"), line("00:00:01", "I/O was resumed on database my.db."),
        line("00:00:04", "I/O was resumed on database MY.DB. No user action"), line("00:00:02", "I/O was resumed on database other."), line("00:00:03", "I/O was resumed on database my.db.", "b")]})
    assert hits(performance.freezes(f), "database_name", "metric") == [("a", 739, 0, "my.db", 2000.0)]


def test_discovery_wide(spark):
    f = facts(spark, {
        "instances": [instance("a", machine_name=None, transport="TCP", tcp_port=1433, start_time=ts("2024-01-02 03:04:05.006")), instance("b", machine_name="H", instance_name="I", product_version="99.0.1.1", transport="Named pipe")],
        "error_log": [dict(instance_id="a", log_date=ts("2024-01-01"), message="System Manufacturer: 'M', System Model: 'X 1'."), dict(instance_id="a", log_date=ts("2024-01-01"), message="Copyright (C) on Windows Server")],
        "trace_flags": [dict(instance_id="a", trace_flag=t) for t in ("3226", "1118", "3226")],
    })
    a, b = reports.health_instances(f).collect()
    assert (a["Server Name"], a["Instance Name"], a["Instance Version"], a["Trace Flag In Use"]) == ("", "(default instance)", "SQL Server 2022", "1118, 3226")
    assert (a["Communication Protocol"], a["Last Restart Time"], a["CPU Configuration"], a["Server Memory in MB"]) == ("TCP on port 1433", "2024-01-02 03:04:05.006", "8 core(s) across 2 CPU socket(s)", "8")
    assert (a["Operating System"], a["Server Type"], a["IP Address"]) == ("Windows Server", "M: X 1", "UNKNOWN")
    assert (b["Instance Name"], b["Instance Version"], b["Communication Protocol"]) == ("I", None, "Named pipe")
    assert set(discovery.NAMES[i] for i in discovery.HEALTH_WIDE) == set(reports.health_instances(f).columns) - {"instance_id"}


def test_audit_of_an_empty_fleet_has_a_stable_schema(spark):
    from fleetaudit.params import AuditParams

    fleet = Fleet.from_frames(spark, {})
    for profile in ("backup", "tempdb"):
        out = audit(profile, fleet, AuditParams("2024-06-01 12:00:00"))
        assert [r.check_id for r in out.collect()] == [0] and "action_step" in out.columns  # the header row alone
