"""Registered queries and their SQL oracles over the driver's tables."""

from __future__ import annotations

from . import change, code, more, parsers, planning, registry, stores, surface, system, text  # noqa: F401  (they register themselves)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
