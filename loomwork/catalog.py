"""All queries of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from loomwork.plans import event_queries, finding_queries, graph_queries, module_queries, store_queries, structure_queries, text_queries, usage_queries, window_queries  # noqa: F401  (they register)
from loomwork.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
