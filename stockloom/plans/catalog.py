"""All registered queries."""

from stockloom.plans import (  # noqa: F401
    graph_queries, mining_queries, model_queries, page_queries, sales_queries, series_queries, stream_queries,
)
from stockloom.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
