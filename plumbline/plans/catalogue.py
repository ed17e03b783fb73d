"""All registered queries of the engine and their SQL."""

from plumbline.plans import source_queries, study_queries  # noqa: F401  (they register themselves)
from plumbline.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
