"""All queries and oracles of the library, by name."""

from __future__ import annotations

from folioflux.plans.catalog import ORACLES, QUERIES
from folioflux.plans import analytics, inventory, layouts, matches, pages, records, reports, retrieval, sequences, texts, workflow  # noqa: F401  they register themselves

__all__ = ["ORACLES", "QUERIES"]
