"""All registered queries."""

from feedloom.workload import (  # noqa: F401
    model_queries,
    stream_queries,
    tables_queries,
    text_queries,
)
from feedloom.workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
