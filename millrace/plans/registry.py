"""All queries of the library over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from . import collection, entities, hiring, inputs, ranking, reports, resolution, rounds, scalars, streams, upserts, work  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
