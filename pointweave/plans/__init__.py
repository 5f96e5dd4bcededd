"""Registered queries of the perception operators."""

from pointweave.plans import join_queries, more_queries, object_queries, record_queries, source_queries, stream_queries  # noqa: F401  register their queries
from pointweave.plans.queries import ORACLE_SQL, QUERIES  # noqa: F401
