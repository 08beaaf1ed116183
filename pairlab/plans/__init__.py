"""Views over the driver tables and the registered queries built on them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("ingest", "cleaning", "pairing", "serving", "resolving", "mapping", "selecting", "scoring", "reporting", "knockouts", "learning")


def load_queries():
    """(queries, SQL texts), both keyed by query name."""
    for name in _MODULES:
        import_module(f"pairlab.plans.{name}")
    registry = import_module("pairlab.plans.registry")
    return dict(registry.QUERIES), dict(registry.ORACLES)
