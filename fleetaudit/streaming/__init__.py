"""Incremental forms of three checks: failed logins, group states, freezes."""
from .checks import failed_login_counts, freeze_pairs, late_lines, latest_group_states, on_time
from .run import run_bounded, run_to_files

__all__ = ["failed_login_counts", "freeze_pairs", "late_lines", "latest_group_states", "on_time", "run_bounded", "run_to_files"]
