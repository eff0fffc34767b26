"""Queries of the sky operators over the driver's tables, with SQL for each that SQL can express.

The tables have no coordinates; a fixed projection puts customers (objects) and orders (detections) on the sky.
"""

from heliograph.queries import sources, text  # noqa: F401  add their queries
from heliograph.queries.sky import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
