"""Named queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pipeline", "telemetry", "sessions", "search", "graphs", "streams", "sequences", "filters", "rules", "memory", "dashboards", "retrieval", "reports")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"quarryline.plans.{m}").QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"quarryline.plans.{m}").SQL.items()}
