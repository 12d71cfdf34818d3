"""The modules that register queries."""

import importlib

NAMES = ["ledger_queries", "history_queries", "snapshot_queries", "object_queries", "change_queries", "package_queries"]


def load() -> None:
    for name in NAMES:
        importlib.import_module(f"auditlake.plans.{name}")
