"""All queries of the library with the SQL that checks them."""

from __future__ import annotations

from . import cluster_queries, graph_queries, jobs, metric_queries, model_queries, text_queries, vector_queries  # noqa: F401
from .base import ORACLES, QUERIES

#: Seeds by shared words, graph propagation from them, and both merged with a dense backfill.
FLAGSHIP = QUERIES["ret_06_merge_backfill"]

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
