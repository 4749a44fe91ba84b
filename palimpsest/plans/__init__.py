"""Registered queries over the given tables, with their SQL checks."""

from . import edit_queries, join_queries, model_queries, refine_queries, scan_queries, text_queries  # noqa: F401
from .catalog import ORACLES, QUERIES, Tables, query  # noqa: F401
