"""The ledger: one row per instance and check, and what each status means."""
from collections import Counter

from helpers import AS_OF, database, facts, instance, table

from fleetaudit.plans.assessment import APPLIES, CHECKS, NEEDS_RIGHTS, assess, assessment
from fleetaudit.plans.catalogue import BASE


def statuses(df) -> dict:
    return {(r.instance_id, r.check_id): r.status for r in df.collect()}


def test_every_check_once_and_gates_name_known_checks():
    assert len(CHECKS) == 209 == len({r.check_id for r in BASE})
    gated = [i for ids in APPLIES.values() for i in ids]
    assert len(gated) == len(set(gated)) and set(gated) | NEEDS_RIGHTS <= set(CHECKS)


def test_statuses(spark):
    rows = [instance("new"), instance("old", product_version="10.50.1.1"), instance("blind", collected_as_sysadmin=False), instance("unknown", collected_as_sysadmin=None, product_version=None),
            instance("managed", engine_edition=8)]
    f = facts(spark, {"instances": rows})
    found = spark.createDataFrame([("new", 203), ("new", 203), ("old", 717), ("blind", 502), ("new", 101), ("gone", 203)], "instance_id string, check_id int")
    members = table(spark, "ag_groups", [dict(instance_id="new", group_id="g"), dict(instance_id="new", group_id="h")])
    got = statuses(assessment(found, f.instances, members, CHECKS))
    assert len(got) == 5 * 209 and not any(k[0] == "gone" for k in got)
    assert got["new", 203] == "failed" and got["old", 203] == "passed"
    assert got["old", 717] == "failed"  # what was found counts, whatever the gate says
    assert (got["new", 717], got["old", 741], got["unknown", 717]) == ("passed", "not applicable", "not applicable")
    assert (got["new", 505], got["blind", 505], got["unknown", 505]) == ("passed", "not assessed", "not assessed")
    assert got["blind", 502] == "failed"
    assert (got["new", 429], got["old", 429]) == ("passed", "not applicable")
    assert (got["new", 602], got["managed", 602], got["unknown", 602]) == ("passed", "not applicable", "not applicable")
    assert (got["new", 101], got["old", 101]) == ("passed", "not assessed")  # a fact that is known, and one that is not


def test_no_findings_and_no_instances(spark):
    none = spark.createDataFrame([], "instance_id string, check_id int")
    f = facts(spark, {"instances": [instance("a")], "ag_groups": []})
    assert len(statuses(assessment(none, f.instances, f.group_instances, CHECKS))) == 209
    empty = facts(spark, {"instances": []})
    assert assessment(none, empty.instances, empty.group_instances, CHECKS).count() == 0


def test_ledger_holds_what_the_profiles_find(spark):
    """One small fleet through all profiles: failed in the ledger is found by a profile, and the other way round."""
    from fleetaudit.plans import findings_of
    from fleetaudit.plans.profiles import PROFILES

    f = facts(spark, {"instances": [instance("a"), instance("b", collected_as_sysadmin=False)],
                      "databases": [database("a", 2, "tempdb", is_encrypted=True), database("a", 5, "x", is_auto_shrink_on=True), database("b", 5, "y", state=1, state_desc="RESTORING")]})
    ledger = statuses(assess(f))
    found = {(r.instance_id, r.check_id) for p in PROFILES for df in findings_of(p, f) for r in df.select("instance_id", "check_id").distinct().collect()}
    assert {k for k, s in ledger.items() if s == "failed"} == {k for k in found if k[1] >= 200}
    assert {k for k, s in ledger.items() if s == "passed" and k[1] < 200} == {k for k in found if k[1] < 200}
    assert set(Counter(ledger.values())) == {"passed", "failed", "not applicable", "not assessed"} and AS_OF
