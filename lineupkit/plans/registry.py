"""All registered roster queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from lineupkit.plans import block_queries, corpus_queries, evaluation_queries, ingest_queries, model_queries, outcome_queries, paste_queries, state_queries, statistics_queries, structure_queries, sweep_queries
from pyspark.sql import DataFrame, SparkSession

MODULES = [block_queries, corpus_queries, evaluation_queries, ingest_queries, model_queries, outcome_queries, paste_queries, state_queries, statistics_queries, structure_queries, sweep_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    SQL |= module.SQL
