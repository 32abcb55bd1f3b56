"""All registered queries of the junction engine and their SQL oracles, by name."""

from __future__ import annotations

from . import aggregate_queries, composite_queries, join_queries, junction_queries, scalar_queries

QUERIES: dict = {}
ORACLES: dict = {}
for module in (scalar_queries, join_queries, aggregate_queries, composite_queries, junction_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
