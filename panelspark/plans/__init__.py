"""Registered queries, one module per operator family."""

from . import q_calendar, q_core, q_stats, q_portfolio, q_evaluate, q_documents, q_audit, q_ml, q_stream  # noqa: F401
from .registry import BUILD, SQL  # noqa: F401
