"""Queries of the library and their SQL twins."""

from . import algebra_queries, chain_queries, field_queries, log_queries, model_queries, recovery_queries, run_queries, store_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
