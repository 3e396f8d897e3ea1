"""The page of all checks, written from the catalogue: ``python -m fleetaudit.plans.pages > docs/checks.md``."""
from __future__ import annotations

from ..operators.report import CATEGORIES, IMPORTANCE
from .catalogue import BASE


def checks_page() -> str:
    categories, levels = dict(CATEGORIES), dict(IMPORTANCE)
    lines = ["# Checks", "", "One entry per check: its importance, what it reports and what to do."]
    last, seen = None, set()
    for r in BASE:
        category = categories[r.check_id // 100]
        if category != last:
            lines += ["", f"## {category}"]
            last = category
        if r.check_id not in seen:
            lines += ["", f'<a id="{r.check_id}"></a>', f"### {r.check_id} {r.name}", "", f"Importance: {levels[r.importance]}"]
            seen.add(r.check_id)
        lines.append("")
        lines.append(f"- {r.issue.replace('{', '<').replace('}', '>')}." + (f" {r.action}" if r.action else ""))
    return "\n".join(lines) + "\n"


if __name__ == "__main__":
    print(checks_page(), end="")
