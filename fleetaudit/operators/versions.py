"""Versions and snapshots."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import constant_table, dotted_part

# Product names by major version (10.5 is the second release of 10): fixed values.
VERSION_NAMES = [("2008", 10.0), ("2008 R2", 10.5), ("2012", 11.0), ("2014", 12.0), ("2016", 13.0),
                 ("2017", 14.0), ("2019", 15.0), ("2022", 16.0), ("2025", 17.0)]

# Lowest patched build by major version: fixed values.
PATCHED_BUILDS = [(11.0, 7507), (12.0, 6449), (13.0, 6500), (14.0, 3540), (15.0, 4480), (16.0, 4262),
                  (17.0, 4060)]

OLDEST_SUPPORTED = 13.0


def version_columns(df: DataFrame, version: str = "product_version") -> DataFrame:
    """``major`` (first part plus one digit of the second) and ``build`` (third part)."""
    first, second = dotted_part(version, 1), dotted_part(version, 2)
    return (df.withColumn("major", F.concat(first, F.lit("."), F.substring(second, 1, 1)).try_cast("double"))
            .withColumn("build", dotted_part(version, 3).try_cast("int")))


def version_gate(df: DataFrame, bands: Sequence[tuple[float, float]], key: str, value: str,
                 inclusive: bool = False) -> DataFrame:
    """Rows whose value lies below the minimum of their band, with ``band_min``.

    ``bands`` is a code table (band key, minimum) and is broadcast as a constant.
    """
    table = constant_table(df.sparkSession, bands, "_band double, band_min double")
    joined = df.join(F.broadcast(table), F.col(key).cast("double") == F.col("_band")).drop("_band")
    return joined.where(F.col(value) <= F.col("band_min") if inclusive else F.col(value) < F.col("band_min"))


def snapshot_of(objects: DataFrame, keys: Sequence[str], link: str, target: str,
                carry: Sequence[str]) -> DataFrame:
    """Each row that points at another row of its owner, with that row's columns as ``source_*``."""
    dim = objects.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col(target).alias("_s_target"),
                         *[F.col(c).alias(f"source_{c}") for c in carry])
    cond = F.col(link) == F.col("_s_target")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_s_{k}"))
    return (objects.where(F.col(link).isNotNull()).join(dim, cond)
            .drop("_s_target", *[f"_s_{k}" for k in keys]))
