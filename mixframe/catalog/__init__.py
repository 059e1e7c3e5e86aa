"""Checkable queries: each operator run on the supplied tables, with the SQL that must give the same rows."""

from __future__ import annotations

from mixframe.catalog import batches, features, fitting, latent, losses, metrics, outputs, schedules, scoring, tables
from mixframe.catalog.base import Query

MODULES = (tables, batches, features, latent, scoring, fitting, losses, schedules, metrics, outputs)


def catalog() -> dict[str, Query]:
    """All queries by name."""
    found: dict[str, Query] = {}
    for module in MODULES:
        for query in module.QUERIES:
            if query.name in found:
                raise ValueError(f"two queries are named {query.name}")
            found[query.name] = query
    return found
