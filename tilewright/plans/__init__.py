"""Queries over the driver tables, by theme."""

from __future__ import annotations


def load_all() -> tuple[dict, dict]:
    """Import every module of queries and return the registered queries and their SQL."""
    from . import geometry_queries, record_queries, registry, tiling_queries  # noqa: F401

    return registry.QUERIES, registry.ORACLES
