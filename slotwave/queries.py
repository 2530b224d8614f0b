"""All registered queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from .plans import queries_compare, queries_core, queries_demand, queries_study
from .plans.registry import ORACLE_SQL, QUERIES

flagship = queries_core.flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "queries_compare", "queries_core", "queries_demand", "queries_study"]
