"""Small fleets written as rows, and findings as sets."""
from __future__ import annotations

from datetime import datetime

from fleetaudit.params import AuditParams
from fleetaudit.plans import Facts
from fleetaudit.schemas import schema_of
from fleetaudit.sources import Fleet

AS_OF = "2024-06-01 12:00:00"


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def table(spark, name: str, rows: list[dict]):
    """Rows as a table of the fleet; columns left out are null."""
    schema = schema_of(name)
    for row in rows:
        unknown = set(row) - set(schema.names)
        assert not unknown, unknown
    return spark.createDataFrame([tuple(row.get(c) for c in schema.names) for row in rows], schema)


def instance(iid: str, **kw) -> dict:
    return dict(dict(instance_id=iid, product_version="16.0.5000.1", engine_edition=3, edition="Enterprise Edition (64-bit)",
                     server_name_var=iid, server_name_prop=iid, collected_as_sysadmin=True, cpu_count=8, hyperthread_ratio=4,
                     physical_memory_kb=8192), **kw)


def database(iid: str, database_id: int, name: str, **kw) -> dict:
    return dict(dict(instance_id=iid, database_id=database_id, name=name, owner_sid="0x01", state=0, state_desc="ONLINE",
                     recovery_model_desc="FULL", user_access_desc="MULTI_USER", page_verify_option_desc="CHECKSUM",
                     compatibility_level=160, is_in_standby=False, is_read_only=False, updateability="READ_WRITE"), **kw)


def facts(spark, tables: dict[str, list[dict]], **params) -> Facts:
    fleet = Fleet.from_frames(spark, {n: table(spark, n, rows) for n, rows in tables.items()})
    return Facts(fleet, AuditParams(AS_OF, **params))


def hits(df, *columns: str) -> list[tuple]:
    """Findings as sorted tuples of instance, check, case and the named columns."""
    return sorted((tuple(r) for r in df.select("instance_id", "check_id", "case_no", *columns).collect()), key=str)
