"""All named queries, collected from the catalog modules."""

from factloom.plans import catalog_facts, catalog_graph, catalog_mechanisms, catalog_retrieval, catalog_sources, catalog_stats, catalog_store, catalog_text  # noqa: F401
from factloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
