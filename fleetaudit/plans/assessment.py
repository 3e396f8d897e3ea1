"""The ledger of an audit: for every instance and check, whether it failed, passed, did not apply or could not be assessed.

Findings alone cannot tell a check that passed from one that was never run. The ledger has one row per
instance and check: 209 an instance.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.stage import staged_union
from ..operators.scope import MANAGED_EDITION
from ..operators.versions import VERSION_NAMES
from . import performance, recoverability, reliability, security
from .catalogue import BASE
from .facts import Facts
from .profiles import findings_of

FAILED, PASSED, NOT_APPLICABLE, NOT_ASSESSED = "failed", "passed", "not applicable", "not assessed"

# Where checks apply, on the facts of an instance (major version, edition, member of a group). Checks that several
# profiles run are held to the widest of their gates; a check that is not listed applies everywhere.
_KNOWN = ", ".join(str(n) for _, n in VERSION_NAMES)
APPLIES: dict[str, tuple[int, ...]] = {
    "in_group": (198, 199, 407, *range(412, 418), 419, 421, 422, *range(424, 433), 504, 506),
    "in_group AND major >= 13": (418, 423),
    "major > 11": (202,), "major < 11": (215,), "major >= 11": (344,), "major >= 12": (210, 212), "major >= 13": (217,),
    "major < 13": (715, 716), "major >= 15": (717,), "major >= 17": (727, 741),
    f"engine_edition <> {MANAGED_EDITION} AND major IN ({_KNOWN})": (601, 602), "engine_edition IN (2, 3, 8)": (502,),
}
# Checks whose facts only a collector with all rights sees, in every profile that runs them.
NEEDS_RIGHTS = frozenset((106, 118, 420, 502, 505, 609, 610, 611, 622, 724, *range(301, 305), 308, 309, *range(311, 356)))


CHECKS = tuple(sorted({r.check_id for r in BASE}))


def assessment(findings: DataFrame, instances: DataFrame, members: DataFrame, checks: Sequence[int]) -> DataFrame:
    """One row per instance and check with its ``status``.

    A finding decides before any gate: what was found failed. Discovery facts (1xx) report what an
    instance is; they pass where the fact is known and are not assessed where it is not. An instance
    with unknown rights counts as collected without them, a gate on an unknown fact as unmet.

    Findings are cut to distinct checks per instance before they meet the instances: at most as many
    numbers as there are checks, however many findings one instance has. Each instance then unfolds
    the list of checks by itself, so nothing is crossed or joined per check.
    """
    found = (findings.select("instance_id", "check_id").distinct()
             .groupBy("instance_id").agg(F.collect_list("check_id").alias("found")))
    gates = [*APPLIES, "true"]
    gate_of = {i: n for n, ids in enumerate(APPLIES.values()) for i in ids}
    listed = F.array(*[F.struct(F.lit(i).alias("check_id"), F.lit(gate_of.get(i, len(gates) - 1)).alias("gate"), F.lit(i in NEEDS_RIGHTS).alias("rights")) for i in checks])
    own = (instances.select("instance_id", "major", "engine_edition", "collected_as_sysadmin")
           .join(members.select("instance_id", F.lit(True).alias("in_group")).distinct(), "instance_id", "left")
           .join(found, "instance_id", "left")
           .withColumn("in_group", F.coalesce("in_group", F.lit(False))))
    rows = own.select("instance_id", "found", F.coalesce("collected_as_sysadmin", F.lit(False)).alias("rights_held"),
                      F.array(*[F.coalesce(F.expr(g), F.lit(False)) for g in gates]).alias("met"), F.explode(listed).alias("c"))
    hit = F.coalesce(F.array_contains("found", F.col("c.check_id")), F.lit(False))
    discovery = F.col("c.check_id") < 200
    status = (F.when(hit, F.when(discovery, PASSED).otherwise(FAILED))
              .when(~F.get("met", F.col("c.gate")), NOT_APPLICABLE)
              .when(F.col("c.rights") & ~F.col("rights_held"), NOT_ASSESSED)
              .when(discovery, NOT_ASSESSED).otherwise(PASSED))
    return rows.select("instance_id", F.col("c.check_id").alias("check_id"), F.expr("CAST(c.check_id DIV 100 AS SMALLINT)").alias("category_id"), status.alias("status"))


def _found(f: Facts) -> list[DataFrame]:
    """Findings of a run of all profiles, by part; what one profile finds is not looked for again in another."""
    backup = [recoverability.history_rules(f), recoverability.split_chains(f), recoverability.coverage(f).where("check_id = 214"), performance.freezes(f)]
    tempdb = [security.tempdb_encrypted(f), reliability.tempdb_files(f), performance.tempdb_layout(f, True).where("check_id = 730"), performance.resource_limits(f),
              performance.accelerated_recovery(f)]
    return [*(df for p in ("health", "security", "ag") for df in findings_of(p, f)), *backup, *tempdb]


def assess(facts: Facts) -> DataFrame:
    """The ledger of a run of all profiles. Each part's findings are written as distinct pairs of instance and check, then counted together."""
    pairs = staged_union([df.select("instance_id", "check_id").distinct() for df in _found(facts)], "found")
    return assessment(pairs, facts.instances, facts.group_instances, CHECKS)
