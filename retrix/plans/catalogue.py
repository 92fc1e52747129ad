"""All queries of the library, apart from those of the training-data subpackage."""

from __future__ import annotations

from retrix.plans import (  # noqa: F401  each module registers its queries
    analysis_queries,
    answer_queries,
    cache_queries,
    catalog_queries,
    chunk_queries,
    code_queries,
    dense_queries,
    engine_queries,
    graph_queries,
    memory_queries,
    monitor_queries,
    pipeline_queries,
    text_queries,
    tree_queries,
)
from retrix.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
