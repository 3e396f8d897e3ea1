"""Space use and page contention."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import fold, resource_part, scaled, statement_slice

# 8 KB pages and bytes per unit: fixed values.
PAGES_PER = {"MB": 128, "GB": 131072}
BYTES_PER = {"MB": 1048576, "GB": 1073741824}


def unit_of(unit: str | None) -> str:
    """Unit in capitals; anything else falls back to MB."""
    return unit.upper() if unit and unit.upper() in PAGES_PER else "MB"


def space_summary(file_space: DataFrame, key: Sequence[str], columns: dict[str, str], unit: str = "MB") -> DataFrame:
    """Sums of page counts per owner in the unit; ``columns`` maps output to page column."""
    per = PAGES_PER[unit_of(unit)]
    return file_space.groupBy(*key).agg(*[scaled(F.sum(c), per).alias(n) for n, c in columns.items()])


def session_space(session_use: DataFrame, task_use: DataFrame, keys: Sequence[str], user_alloc: str,
                  user_dealloc: str, internal_alloc: str, internal_dealloc: str, unit: str = "MB") -> DataFrame:
    """Net space per active session: what the session kept and what its running tasks hold.

    A session is active when it or a task of it allocated anything. Task rows are summed first.
    """
    per = PAGES_PER[unit_of(unit)]
    active = (F.col(user_alloc) > 0) | (F.col(internal_alloc) > 0)
    ids = session_use.where(active).select(*keys).union(task_use.where(active).select(*keys)).distinct()
    net_user, net_internal = F.col(user_alloc) - F.col(user_dealloc), F.col(internal_alloc) - F.col(internal_dealloc)

    def amounts(prefix: str, wrap):
        return [scaled(wrap(net_user + net_internal), per).alias(f"{prefix}_space"),
                scaled(wrap(net_user), per).alias(f"{prefix}_user_space"),
                scaled(wrap(net_internal), per).alias(f"{prefix}_internal_space")]

    held = session_use.select(*keys, *amounts("session", lambda c: c))
    running = task_use.groupBy(*keys).agg(*amounts("running", F.sum))
    return ids.join(held, list(keys), "left").join(running, list(keys), "left")


def transaction_log_use(transactions: DataFrame, unit: str = "MB") -> DataFrame:
    """Transactions that wrote log, with log space in the unit and the running statement."""
    per = BYTES_PER[unit_of(unit)]
    return (transactions.where(F.col("log_bytes_used") > 0)
            .withColumn("log_used", scaled("log_bytes_used", per))
            .withColumn("log_reserved", scaled("log_bytes_reserved", per))
            .withColumn("statement_text", statement_slice("batch_text", "statement_start", "statement_end")))


# Page types and latch modes that tell the two kinds of contention apart: fixed values.
ALLOCATION_PAGES = ("SGAM_PAGE", "GAM_PAGE", "PFS_PAGE")
METADATA_PAGES = ("DATA_PAGE", "INDEX_PAGE")
LATCH_MODES = ("PAGELATCH_SH", "PAGELATCH_UP", "PAGELATCH_EX")


def contention(requests: DataFrame, page_info: DataFrame, keys: Sequence[str] = ("instance_id",),
               database_id: int = 2) -> DataFrame:
    """Page-latch waits on one database with their page and kind of contention."""
    waits = (requests.where(fold("wait_type").startswith("pagelatch")
                            & F.col("wait_resource").startswith(f"{database_id}:"))
             .withColumn("database_id", resource_part("wait_resource", 1))
             .withColumn("file_id", resource_part("wait_resource", 2))
             .withColumn("page_id", resource_part("wait_resource", 3)))
    latch = F.upper("wait_type").isin(*LATCH_MODES)
    kind = (F.when(F.upper("page_type_desc").isin(*ALLOCATION_PAGES) & latch, "ALLOCATION CONTENTION")
            .when(F.upper("page_type_desc").isin(*METADATA_PAGES) & latch, "METADATA CONTENTION"))
    return (waits.join(page_info, [*keys, "database_id", "file_id", "page_id"])
            .withColumn("contention_kind", kind))
