"""All named queries of the engine."""

from . import join_queries, ledger_queries, pattern_queries, proof_queries, record_queries, rollup_queries, series_queries, streaming_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "join_queries", "ledger_queries", "pattern_queries", "proof_queries", "record_queries", "rollup_queries", "series_queries", "streaming_queries"]
