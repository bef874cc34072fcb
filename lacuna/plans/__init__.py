"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("panel_queries", "stat_queries", "market_queries", "policy_queries", "serve_queries", "density_queries", "router_queries", "scan_queries", "stream_queries", "variant_queries")


def _all() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= import_module(f".{m}", __name__).QUERIES
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql is not None}
