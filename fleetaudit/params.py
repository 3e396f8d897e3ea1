"""Parameters of an audit run."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .functions import as_ts


@dataclass(frozen=True)
class AuditParams:
    """``as_of`` stands for "now", so that a run can be repeated. Unset filters do not apply."""
    as_of: str
    start: str | None = None              # default: seven days before as_of
    end: str | None = None                # default: as_of
    database_name: str | None = None
    backup_type: str | None = None        # Full, Differential or Transaction Log
    device_type: str | None = None        # Disk, Tape, Virtual Device, Azure Storage
    show_copy_only: bool | None = None
    objective_minutes: int | None = None  # recovery point objective; unset turns check 214 off
    group_name: str | None = None
    local_only: bool | None = None
    check_local_admins: bool = False
    preferred_owner: str | None = None
    unit: str = "MB"
    usage_percent: int = 50
    read_stall_ms: int = 100
    write_stall_ms: int = 100
    certificate_within_days: int | None = None  # unset lists certificates however late they expire
    stage_facts: bool = False             # write facts that several checks share to the shared folder

    def __post_init__(self):
        object.__setattr__(self, "usage_percent", min(self.usage_percent, 100))
        object.__setattr__(self, "read_stall_ms", max(self.read_stall_ms, 0))
        object.__setattr__(self, "write_stall_ms", max(self.write_stall_ms, 0))

    @property
    def now(self) -> Column:
        return as_ts(self.as_of)

    def ago(self, interval: str) -> Column:
        return self.now - F.expr(f"INTERVAL {interval}")

    @property
    def range_start(self) -> Column:
        return as_ts(self.start) if self.start else self.ago("7 DAYS")

    @property
    def range_end(self) -> Column:
        return as_ts(self.end) if self.end else self.now
