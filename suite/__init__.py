"""Every operator as a query over the test tables, with its SQL counterpart."""

from suite import count_queries, model_queries, stream_queries, text_queries  # noqa: F401
from suite.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
