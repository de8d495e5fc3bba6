"""Length buckets anchored at the shortest sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combforge.config import require


def assign_buckets(sequences: DataFrame, width: int = 10) -> DataFrame:
    """Adds ``bucket`` (from 0); the shortest length comes from a one-row aggregate."""
    require(width > 0, "partition_width must be positive")
    least = sequences.agg(F.min(F.size("features")).alias("least"))
    return sequences.join(F.broadcast(least)).withColumn("bucket", F.floor((F.size("features") - F.col("least")) / width).cast("int")).drop("least")


def bucket_ranges(sequences: DataFrame, width: int = 10) -> DataFrame:
    """Non-empty buckets: bucket, lo, hi, n_sequences, min_len, max_len."""
    n = F.size("features")
    ends = sequences.agg(F.min(n).alias("least"), F.max(n).alias("most"))
    by = assign_buckets(sequences, width).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_sequences"), F.min(n).alias("min_len"), F.max(n).alias("max_len"))
    lo = F.col("least") + F.col("bucket") * width
    return by.join(F.broadcast(ends)).select("bucket", lo.alias("lo"), F.least(lo + (width - 1), F.col("most")).alias("hi"), "n_sequences", "min_len", "max_len")
