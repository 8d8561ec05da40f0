"""All queries of the library, by name."""

from courierlens.plans import fusion, intake, relational, scenes, signals, stats, temporal, text, training, verdicts, webmail  # noqa: F401
from courierlens.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
