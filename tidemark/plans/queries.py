"""All queries over the reference's operators, by their number in the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.consensus import distinct_buyer_score, rank_recommendations
from ..sources.fixtures import view
from . import activation_queries, certify_queries, extra_queries, identity_queries, market_queries, portfolio_queries, quality_queries, row_queries, scalar_queries, setup_queries, source_queries, stream_queries

_PARTS = (scalar_queries, market_queries, row_queries, portfolio_queries, quality_queries, stream_queries, extra_queries, identity_queries, certify_queries, setup_queries, activation_queries, source_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str, days: int = 28) -> DataFrame:
    """Which securities had three distinct buyers or more, disclosed in the last ``days``."""
    scored = distinct_buyer_score(view(spark, sf_dir, "fx_disclosures"), F.lit("1998-06-01").cast("date"), days=days)
    return rank_recommendations(scored.where("signal_score > 0"), 15)
