"""All queries by name, and their SQL."""

from __future__ import annotations

from . import audit, content, layout, mining, outline, report

MODULES = (audit, report, mining, content, outline, layout)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
