"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from .plans import adapter_queries, bin_queries, evidence_queries, label_queries, metric_queries, mixture_queries, more_queries, pipelines, relational_queries, replay_queries, series_queries, shard_queries, stages, text_queries, verdict_queries, vocabulary_queries, window_queries  # noqa: F401
from .plans.registry import QUERIES, SQL

FLAGSHIP = "flagship"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
