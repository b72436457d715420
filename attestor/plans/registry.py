"""All queries of the analytics operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestor.plans import claim_queries, eval_queries, graph_queries, model_queries, series_queries, source_queries, spec_queries, stats_queries, store_queries, study_queries, text_queries

MODULES = (graph_queries, series_queries, stats_queries, store_queries, text_queries, model_queries, eval_queries, spec_queries, claim_queries, source_queries, study_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLE.items()}
