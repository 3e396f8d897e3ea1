"""Cut points: a shared intermediate written once, as a table that survives lost executors."""
from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from ..session import shared_dir

# Parts of a union that share a plan: some share shuffles, and their stages fill the cores.
PARTS_AT_ONCE = 4

_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    Worth it where several plans start from one costly join or aggregate: each then reads just its
    columns, and a lost executor costs a re-read, not a re-derivation.
    """
    path = f"{_folder.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _common_schema(parts: Sequence[DataFrame]) -> StructType:
    """Schema of the union of ``parts`` by name."""
    schemas = [part.schema for part in parts]
    kinds = [{f.name: f.dataType for f in schema} for schema in schemas]
    if any(kind != kinds[0] for kind in kinds):
        return reduce(DataFrame.unionByName, parts).schema
    return StructType([StructField(f.name, f.dataType, any(schema[f.name].nullable for schema in schemas)) for f in schemas[0]])


def staged_union(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """The union of ``parts`` by name, written a few parts at a time and read back as one table.

    A union of a hundred parts is one plan, which the driver holds and makes anew after every shuffle of it. Written
    in groups, no plan is larger than that of a few parts, and what a group shuffled can go before the next one starts.
    """
    spark, schema = parts[0].sparkSession, _common_schema(parts)
    path = f"{_folder.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    typed = [part.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]) for part in parts]
    for n in range(0, len(typed), PARTS_AT_ONCE):
        reduce(DataFrame.unionByName, typed[n:n + PARTS_AT_ONCE]).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, not made yet, in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def folder_within(spark: SparkSession, name: str) -> str:
    """A folder of its own, not made yet, in the one that staged tables go to now."""
    return f"{_folder.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def staged_in(folder: str):
    """Tables staged meanwhile go to this folder, so that they can be discarded together."""
    token = _folder.set(folder)
    try:
        yield
    finally:
        _folder.reset(token)


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder of staged tables that no plan reads any more, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
