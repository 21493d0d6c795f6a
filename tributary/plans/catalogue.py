"""All registered queries of the engine and the SQL they are checked against."""

from __future__ import annotations

from tributary.plans import feature_queries, flow_queries, graph_queries, path_queries, task_queries

MODULES = (graph_queries, task_queries, feature_queries, path_queries, flow_queries)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.REGISTRY.sql.items()}
