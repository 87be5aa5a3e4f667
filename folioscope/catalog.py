"""Registry of the engine's own queries and their SQL oracles."""

from __future__ import annotations

from folioscope.plans import domain, drawn, geometry, grids, joins, library, search, segment, text  # noqa: F401  (they register their queries)
from folioscope.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
