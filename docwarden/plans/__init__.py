"""Whole jobs assembled from the operators, and the registry of checked queries."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """Registered queries and their SQL; the modules register on import."""
    from docwarden.plans import accounts, cleaning, files, reports, streams, training  # noqa: F401
    from docwarden.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
