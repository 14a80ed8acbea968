"""All queries: importing this module registers those of every query module."""

from mnemograph.plans import corpus_queries, evidence_queries, memory_queries, reader_queries, render_queries, selection_queries, writing_queries
from mnemograph.plans.registry import ORACLES, QUERIES

FLAGSHIP = "temporal_forward"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "corpus_queries", "evidence_queries", "memory_queries", "reader_queries", "render_queries", "selection_queries", "writing_queries"]
