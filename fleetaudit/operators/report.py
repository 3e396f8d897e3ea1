"""Findings (O22, O23): rule texts, assembly, order."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import as_ts, constant_table

# Categories and importance levels: fixed values.
CATEGORIES = [(0, " "), (1, "Discovery"), (2, "Recoverability"), (3, "Security"), (4, "Availability"),
              (5, "Integrity"), (6, "Reliability"), (7, "Performance")]
IMPORTANCE = [(0, "Informational"), (1, "High"), (2, "Medium"), (3, "Low")]

# What operators and rules emit; texts join only in the report.
RAW_COLUMNS = ["instance_id", "check_id", "case_no", "database_name", "object_name", "metric"]
FINDING_COLUMNS = ["instance_id", "category_id", "check_id", "importance", "check_name", "issue",
                   "database_name", "details", "action_step", "read_more_url", "metric"]


@dataclass(frozen=True)
class Rule:
    """Texts of one check. ``issue`` may use {database}, {object} and {metric}."""
    check_id: int
    importance: int
    name: str
    issue: str
    action: str
    case_no: int = 0
    category: int | None = None


def rule_dimension(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.check_id, r.case_no, r.check_id // 100 if r.category is None else r.category, r.importance,
             r.name, r.issue, r.action) for r in rules]
    return constant_table(spark, rows, "check_id int, case_no int, category_id int, importance int, "
                                       "check_name string, issue string, action_step string")


def _filled(template: Column) -> Column:
    text = template
    number = F.regexp_replace(F.col("metric").cast("decimal(28,3)").cast("string"), r"\.?0+$", "")
    for mark, value in (("{database}", F.col("database_name")), ("{object}", F.col("object_name")), ("{metric}", number)):
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit("")))
    return text


def report(parts: Sequence[DataFrame], rules: Sequence[Rule], as_of=None, min_importance: int | None = None,
           discovery: bool = True, order: str = "standard", title: str = "Fleet audit") -> DataFrame:
    """Union of raw findings with texts, category and importance labels, sorted.

    ``order`` is ``standard`` (importance, category, check, issue, database) or ``by_name``
    (importance, name, database, details). ``min_importance`` keeps that level and stronger ones.
    With ``as_of`` every row carries the capture date, and one header row (check 0, category 0) with ``title`` stands for
    the run itself: it is there whatever the filters, also where nothing was found.
    """
    raw = reduce(DataFrame.unionByName, [p.select(*RAW_COLUMNS) for p in parts])
    spark = raw.sparkSession
    dim = F.broadcast(rule_dimension(spark, rules))
    rows = raw.join(dim, ["check_id", "case_no"], "left")
    # A finding without a text still shows: at high importance, under its number, in the category of its hundred.
    number = F.concat(F.lit("Check "), F.col("check_id").cast("string"))
    plain = {"category_id": F.floor(F.col("check_id") / 100).cast("int"), "importance": F.lit(1), "check_name": number,
             "issue": F.concat(number, F.lit(" has no text")), "action_step": F.lit("Add a text for this check.")}
    rows = rows.withColumns({name: F.coalesce(name, value) for name, value in plain.items()})
    if not discovery:
        rows = rows.where(F.col("category_id") > 1)
    if min_importance is not None:
        rows = rows.where((F.col("importance") > 0) & (F.col("importance") <= min_importance))
    cats = constant_table(spark, CATEGORIES, "category_id int, category string")
    levels = constant_table(spark, IMPORTANCE, "importance int, importance_label string")
    rows = rows.join(F.broadcast(cats), "category_id", "left").join(F.broadcast(levels), "importance", "left")
    out = rows.select(
        "instance_id", F.col("category_id").cast("short").alias("category_id"), "category", "check_id",
        F.col("importance").cast("short").alias("importance"), "importance_label", "check_name",
        _filled(F.col("issue")).alias("issue"), "database_name",
        F.coalesce("object_name", F.lit("")).alias("details"), "action_step",
        F.concat(F.lit("docs/checks.md#"), F.col("check_id").cast("string")).alias("read_more_url"), "metric")
    if as_of is not None:
        day = F.date_format(as_ts(as_of), "MM/dd/yyyy")
        header = {"category_id": 0, "category": dict(CATEGORIES)[0], "check_id": 0, "importance": 0, "importance_label": dict(IMPORTANCE)[0], "check_name": title,
                  "issue": F.concat(F.lit("Information captured on "), day), "details": "", "action_step": "Start with the findings of high importance.",
                  "read_more_url": "docs/checks.md"}
        first = spark.range(1).select(*[(v if isinstance(v, Column) else F.lit(v)).cast(out.schema[c].dataType).alias(c)
                                        for c, v in ((c, header.get(c)) for c in out.columns)])
        out = out.unionByName(first).withColumn("captured_on", day)
    keys = {"standard": ["importance", "category_id", "check_id", "issue", "database_name"],
            "by_name": ["importance", "check_name", "database_name", "details"]}[order]
    return out.orderBy(*keys, "instance_id")


def reclassify(findings: DataFrame, rules: Sequence[tuple[int, Column, int]]) -> DataFrame:
    """Change the check id of findings that meet a condition; first match wins.

    Importance and texts follow the id, as they join only in the report.
    """
    new = None
    for old_id, condition, new_id in rules:
        test = (F.col("check_id") == old_id) & condition
        new = F.when(test, new_id) if new is None else new.when(test, new_id)
    return findings.withColumn("check_id", new.otherwise(F.col("check_id")).cast("int"))
