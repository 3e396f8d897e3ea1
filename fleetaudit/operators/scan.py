"""Row rules and setting rules (O1-O3): many checks, one pass over the table."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constant_table, fold


@dataclass(frozen=True)
class RowRule:
    """One check on single rows. ``when`` may be null; null never fires."""
    check_id: int
    when: Column
    database: Column | None = None
    object: Column | None = None
    metric: Column | None = None
    case_no: int = 0


def _hit(rule: RowRule) -> Column:
    def typed(c, kind):
        return (F.lit(None) if c is None else c).cast(kind)

    return F.struct(F.lit(rule.check_id).alias("check_id"), F.lit(rule.case_no).alias("case_no"),
                    typed(rule.database, "string").alias("database_name"),
                    typed(rule.object, "string").alias("object_name"),
                    typed(rule.metric, "double").alias("metric"))


def rule_scan(df: DataFrame, rules: Sequence[RowRule], keep: Sequence[str] = ("instance_id",)) -> DataFrame:
    """O1: one output row per input row and true rule, from a single scan of ``df``.

    A row that meets no rule is dropped before the generator runs, and the disjunction of the
    rules is left to Catalyst to push to the scan where it can.
    """
    any_rule = rules[0].when
    for r in rules[1:]:
        any_rule = any_rule | r.when
    # Nulls leave after the generator: a filter inside the array would not be compiled.
    hits = F.array(*[F.when(r.when, _hit(r)) for r in rules])
    return (df.where(any_rule)
            .select(*keep, F.explode(hits).alias("_hit"))
            .where(F.col("_hit").isNotNull())
            .select(*keep, "_hit.*"))


@dataclass(frozen=True)
class SettingRule:
    """A named setting tested against a value: op is one of = <> < <= > >= or ``any``.

    ``versions`` is an inclusive range of major versions, None for open.
    """
    check_id: int
    name: str
    op: str
    value: float | None = None
    case_no: int = 0
    versions: tuple[float | None, float | None] = (None, None)
    column: str = "value_in_use"


def _setting_table(spark, rules: Sequence[SettingRule]) -> DataFrame:
    rows = [(r.check_id, r.case_no, r.name.lower(), r.op, r.value, *r.versions) for r in rules]
    return constant_table(spark, rows, "check_id int, case_no int, rule_name string, rule_op string, "
                                       "rule_value double, min_version double, max_version double")


def _compare(value: Column) -> Column:
    op, limit = F.col("rule_op"), F.col("rule_value")
    return (F.when(op == "any", value.isNotNull())
            .when(op == "=", value == limit).when(op == "<>", value != limit)
            .when(op == "<", value < limit).when(op == "<=", value <= limit)
            .when(op == ">", value > limit).when(op == ">=", value >= limit))


def settings_rules(settings: DataFrame, rules: Sequence[SettingRule], name: str = "name",
                   value: str = "value_in_use", keep: Sequence[str] = ("instance_id",),
                   version: str | None = None) -> DataFrame:
    """O2: rows of a name/value table that break a rule; the rules ride along as a constant table.

    With ``version`` (a column of ``settings``) the version range of each rule applies too.
    """
    table = F.broadcast(_setting_table(settings.sparkSession, rules))
    joined = settings.join(table, fold(name) == F.col("rule_name")).where(_compare(F.col(value)))
    if version:
        joined = joined.where((F.col("min_version").isNull() | (F.col(version) >= F.col("min_version")))
                              & (F.col("max_version").isNull() | (F.col(version) <= F.col("max_version"))))
    return joined.select(*keep, "check_id", "case_no", F.lit(None).cast("string").alias("database_name"),
                         F.col(name).alias("object_name"), F.col(value).cast("double").alias("metric"))


def settings_states(instances: DataFrame, settings: DataFrame, rules: Sequence[tuple[int, str]],
                    name: str = "key", value: str = "value") -> DataFrame:
    """O2, report mode: ENABLED, DISABLED or UNKNOWN for each instance and key, present or not."""
    wanted = F.array(*[F.struct(F.lit(c).alias("check_id"), F.lit(k).alias("rule_key")) for c, k in rules])
    keys = [k.lower() for _, k in rules]
    want = instances.select("instance_id", F.explode(wanted).alias("w")).select("instance_id", "w.*")
    have = (settings.where(fold(name).isin(keys))
            .groupBy("instance_id", fold(name).alias("_key")).agg(F.max(value).alias("_value")))
    return (want.join(have.withColumnRenamed("instance_id", "_iid"),
                      (F.col("instance_id") == F.col("_iid")) & (fold("rule_key") == F.col("_key")), "left")
            .select("instance_id", "check_id", F.lit(0).alias("case_no"),
                    F.lit(None).cast("string").alias("database_name"),
                    F.when(F.col("_value") == "1", "ENABLED").when(F.col("_value") == "0", "DISABLED")
                    .otherwise("UNKNOWN").alias("object_name"),
                    F.col("_value").try_cast("double").alias("metric")))


def compare_cols(df: DataFrame, left: Column, right: Column, equal: bool = False) -> DataFrame:
    """O3: rows where two attributes differ (or agree); a null on either side never fires."""
    return df.where(left == right if equal else left != right)


def settings_drift(settings: DataFrame, configured: str = "value", running: str = "value_in_use",
                   name: str = "name", tolerated: dict[str, Sequence[int]] | None = None) -> DataFrame:
    """O3: settings whose configured value is not the running one.

    ``tolerated`` maps a setting to values that count as the same (a minimum of 0 runs as 16).
    """
    drift = F.col(configured) != F.col(running)
    for setting, values in (tolerated or {}).items():
        drift = drift & ~((fold(name) == setting.lower()) & F.col(configured).isin(list(values))
                          & F.col(running).isin(list(values)))
    return settings.where(drift)


def settings_pair(settings: DataFrame, first: str, second: str, name: str = "name",
                  value: str = "value_in_use", keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """O3: two settings of one owner side by side as ``first_value`` and ``second_value``."""
    key = fold(name)
    return (settings.where(key.isin(first.lower(), second.lower()))
            .groupBy(*keys)
            .agg(F.max(F.when(key == first.lower(), F.col(value))).alias("first_value"),
                 F.max(F.when(key == second.lower(), F.col(value))).alias("second_value")))
