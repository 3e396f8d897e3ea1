"""Constant tables: rule lists and code tables that live in this package.

Their size is fixed by the code, never by the data, which is what makes broadcasting them safe.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MAX_CONSTANT_ROWS = 2_000


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def constant_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """Local relation from literal rows; ``schema`` is a DDL string such as ``a int, b string``."""
    if not 0 < len(rows) <= MAX_CONSTANT_ROWS:
        raise ValueError(f"a constant table holds 1 to {MAX_CONSTANT_ROWS} rows, got {len(rows)}")
    fields = [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema).fields]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    names = ", ".join(name for name, _ in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
