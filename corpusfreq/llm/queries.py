"""All queries of this subpackage."""

from __future__ import annotations

from corpusfreq.llm import (  # noqa: F401
    join_queries,
    lm_queries,
    native_queries,
    text_queries,
    token_queries,
    vector_queries,
)
from corpusfreq.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
