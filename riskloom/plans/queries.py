"""All queries of the library and their SQL."""

from riskloom.plans import derived_queries, domain_queries, extension_queries, governance_queries, risk_queries  # noqa: F401  (they register their queries)
from riskloom.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
