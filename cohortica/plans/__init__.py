"""Query modules; importing one registers its queries."""

from __future__ import annotations

import importlib

MODULES: list[str] = [
    "q_metrics",
    "q_contracts",
    "q_features",
    "q_tables",
    "q_splits",
    "q_inference",
    "q_ensemble",
    "q_survival",
    "q_models",
    "q_lineage",
    "q_sinks",
]


def load_queries():
    from cohortica.plans import registry
    for name in MODULES:
        importlib.import_module(f"cohortica.plans.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
