"""Where fleet tables come from and where findings go."""
from .fleet import Fleet, align, in_range, latest_snapshot
from .logs import read_event_payloads, read_log_text
from .sinks import read_findings, write_backup_history, write_findings, write_history, write_snapshot

__all__ = ["Fleet", "align", "in_range", "latest_snapshot", "read_event_payloads", "read_findings", "read_log_text",
           "write_backup_history", "write_findings", "write_history", "write_snapshot"]
