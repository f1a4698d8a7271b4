"""Queries of the text-analytics operators and their SQL."""

import glossa.queries_learned
import glossa.queries_tables
import glossa.queries_trees  # noqa: F401  these register their queries
from glossa.queries import ORACLES, QUERIES

FLAGSHIP = "token_rule_basic"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
