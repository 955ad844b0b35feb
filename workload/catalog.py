"""All query modules; importing them fills the registry."""

from workload import baseline_queries, curation_queries, metric_queries, mining_queries, structure_queries, vector_queries  # noqa: F401
from workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
