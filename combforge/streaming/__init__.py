"""Streaming counts: sketch cells add up, so micro-batches merge."""

from __future__ import annotations

from pyspark.sql import DataFrame

from combforge.config import MiningConfig
from combforge.plans.mine import MiningPlan


def streaming_counts(stream: DataFrame, config: MiningConfig) -> DataFrame:
    """Running exact counts of a stream of nested sequences (complete or update mode)."""
    return MiningPlan(stream, config.with_(count_scope="global")).count()


def streaming_cells(stream: DataFrame, config: MiningConfig) -> DataFrame:
    """Running sketch cells of a stream; state is bounded by rows * cols.

    The keys are not pre-aggregated: a stream takes one aggregation.
    """
    from pyspark.sql import functions as F

    plan = MiningPlan(stream, config.with_(count_scope="global"))
    return plan.sketch()._addressed(plan._enumerate(False)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("cnt"))
