"""Registered queries; importing the package fills ``QUERIES`` and ``ORACLES``."""

from . import views  # noqa: F401  (defines the SQL views first)
from . import q_facts, q_scoring, q_analyst, q_text, q_promises, q_news, q_graph, q_retrieval, q_io, q_streaming  # noqa: F401
from .registry import ORACLES, QUERIES, VIEWS, query, with_views

__all__ = ["ORACLES", "QUERIES", "VIEWS", "query", "with_views"]
