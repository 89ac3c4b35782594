"""Fixture views and the registered query set."""

from __future__ import annotations

import importlib

MODULES = ("q_features", "q_signals", "q_quality", "q_market", "q_execution", "q_evidence", "q_stream", "q_files")


def load_queries():
    """Import every query module once and return the registry."""
    from barlake.plans.registry import QUERIES

    for module in MODULES:
        importlib.import_module(f"barlake.plans.{module}")
    return QUERIES
