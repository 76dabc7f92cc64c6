"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from laneguard.plans import graph_queries, order_queries, text_queries  # noqa: F401
from laneguard.plans.registry import QUERIES, bind, check_sql

__all__ = ["QUERIES", "bind", "check_sql"]
