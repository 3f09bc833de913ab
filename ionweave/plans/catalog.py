"""All registered queries and their oracle texts."""

from __future__ import annotations

import importlib

from ionweave.plans.registry import QUERIES, oracle_texts

AREAS = ("coordination", "dynamics", "pairs", "mobility", "comotion", "network", "sliding", "transport", "ligands", "exchange")
for area in AREAS:
    importlib.import_module(f"ionweave.plans.q_{area}")

ORACLES = oracle_texts()

__all__ = ["QUERIES", "ORACLES"]
