"""All queries of the engine, by name, and their SQL."""

from . import analysis, pixels, serving, simulation, spatial  # noqa: F401
from .views import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
