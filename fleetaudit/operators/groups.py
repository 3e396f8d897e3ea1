"""Group tests and reshaping."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from ..functions import constant_table


def _value(value) -> Column:
    if isinstance(value, str):
        return F.col(value)
    return value if isinstance(value, Column) else F.struct(*value)


def group_heterogeneity(df: DataFrame, group: Sequence[str], value, members: bool = False,
                        count: bool = False) -> DataFrame:
    """Groups holding more than one distinct non-null value.

    Values of fixed width are compared by minimum and maximum, which combine in a hash aggregate on
    the map side. Text and structs would make that aggregate sort its input, so there the distinct
    (group, value) rows are counted; so too where ``count`` asks for the number. ``members`` returns
    the rows of those groups in place of the groups.
    """
    v = _value(value)
    wide = isinstance(df.select(v).schema[0].dataType, (StringType, BinaryType, StructType))
    if count or wide:
        mixed = (df.groupBy(*group).agg(F.countDistinct(v).alias("distinct_values"))
                 .where("distinct_values > 1"))
        mixed = mixed if count else mixed.drop("distinct_values")
    else:
        mixed = (df.groupBy(*group).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
                 .where("_lo <> _hi").drop("_lo", "_hi"))
    return df.join(mixed, list(group), "left_semi") if members else mixed


def group_threshold(df: DataFrame, group: Sequence[str], aggs: dict[str, Column], having: str) -> DataFrame:
    """Aggregates per group, kept where ``having`` (over the aggregate names) is true."""
    return df.groupBy(*group).agg(*[c.alias(n) for n, c in aggs.items()]).where(having)


def ratio_threshold(df: DataFrame, numerator: Column, denominator: Column, limit: float,
                    name: str = "ratio") -> DataFrame:
    """Rows whose ratio exceeds the limit; a zero or null denominator never fires."""
    ratio = numerator / F.nullif(denominator, F.lit(0))
    return df.withColumn(name, ratio).where(F.col(name) > F.lit(limit))


def conditional_sum_compare(df: DataFrame, group: Sequence[str], amount, first: Column, second: Column,
                            at_least=None) -> DataFrame:
    """Groups where the sum over one class exceeds the sum over another (and ``at_least``)."""
    a = _value(amount)
    sums = df.groupBy(*group).agg(F.sum(F.when(first, a)).alias("first_sum"),
                                  F.sum(F.when(second, a)).alias("second_sum"))
    kept = sums.where(F.col("first_sum") > F.col("second_sum"))
    return kept if at_least is None else kept.where(F.col("first_sum") > F.lit(at_least))


def attributes_wide(attrs: DataFrame, names: Sequence[str], key: str = "instance_id", attr: str = "attr",
                    value: str = "details") -> DataFrame:
    """Attribute rows to one wide row per owner. The names are given, so no pass finds them."""
    return attrs.groupBy(key).pivot(attr, list(names)).agg(F.min(value))


def label_dim(df: DataFrame, code: str, labels: Sequence[tuple], default: str, name: str) -> DataFrame:
    """Text for a code from a constant table, with a default."""
    kind = df.schema[code].dataType.simpleString()
    table = constant_table(df.sparkSession, labels, f"_code {kind}, _label string")
    return (df.join(F.broadcast(table), F.col(code) == F.col("_code"), "left")
            .withColumn(name, F.coalesce("_label", F.lit(default))).drop("_code", "_label"))


def string_list(df: DataFrame, keys: Sequence[str], value: str, name: str, sep: str = ", ") -> DataFrame:
    """The ordered distinct values of a group in one cell.

    Duplicates go in a first aggregate, so what meets in one cell is the distinct values only.
    """
    distinct = df.select(*keys, F.col(value).cast("string").alias("_v")).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("_v")), sep).alias(name))
