"""Exact counting and selection.

Counts are aggregated per key (partial aggregation before the shuffle) and
joined back. A window over the key would put every occurrence of a hot motif
into one task; the join lets adaptive execution split it or broadcast the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_keys(occurrences: DataFrame, keys: list[str]) -> DataFrame:
    return occurrences.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def scoped_counts(occurrences: DataFrame, keys: list[str], scope: str) -> tuple[DataFrame, list[str]]:
    """Counts by key, and the columns to join them on.

    global: over all rows. partition: within a length bucket. prefix: over the
    bucket and all shorter ones.
    """
    if scope == "global":
        return count_keys(occurrences, keys), keys
    own = occurrences.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("count"))
    if scope == "prefix":
        running = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(Window.unboundedPreceding, 0)
        own = own.select(*keys, "bucket", F.sum("count").over(running).alias("count"))
    return own, [*keys, "bucket"]


def select_frequent(occurrences: DataFrame, counts: DataFrame, on: list[str], min_count: int) -> DataFrame:
    """Occurrences whose key counts at least ``min_count``, with the count."""
    return occurrences.join(counts.filter(F.col("count") >= min_count), on)
