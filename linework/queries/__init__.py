"""Registered queries: QUERIES[name](spark, sf_dir) and, where SQL can say the same, SQL[name]."""

from linework.queries import drawings, geometry, more, regions, relations, texts  # noqa: F401  (they register themselves)
from linework.queries.views import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
