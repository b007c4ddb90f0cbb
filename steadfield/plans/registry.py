"""Named queries of the engine and, where SQL can express them, the same in ANSI SQL."""

from __future__ import annotations

from . import coding, exact, files, grids, invariants, joins, tiles  # noqa: F401  they register their queries
from .base import ORACLE_SQL, QUERIES

FLAGSHIP = "q_conserve_mass_energy"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
