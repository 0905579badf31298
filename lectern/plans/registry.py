"""Queries and their SQL, by name."""

from lectern.plans import census_queries, claim_queries, evidence_queries, extract_queries, framing_queries, join_queries, relation_queries, scoring_queries, source_queries, store_queries, text_queries, vocabulary_queries  # noqa: F401  (they register)
from lectern.plans._query import ORACLE, QUERIES

FLAGSHIP = "a09_distinct_origins"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
