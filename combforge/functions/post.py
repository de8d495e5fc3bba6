"""What users do with a mining result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combforge.operators.combine import enumerate_combinations
from combforge.sources import ORDINARY, normalise


def motif_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if len(c) > 1 and c[0] == "m" and c[1:].isdigit()]


def filter_count(mined: DataFrame, at_least: int) -> DataFrame:
    return mined.filter(F.col("count") >= at_least)


def unique_motifs(mined: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per motif; count is constant within a motif."""
    return mined.groupBy(*(keys or motif_names(mined))).agg(F.max("count").alias("count"))


def motif_stats(mined: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return mined.groupBy(*(keys or motif_names(mined))).agg(F.max("count").alias("count"), F.avg(F.col("contribution").cast("double")).alias("mean_contribution"))


def top_motifs(stats: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The n most frequent, ties by key."""
    return stats.orderBy(F.desc("count"), *(keys or motif_names(stats))).limit(n)


def containing_set(mined: DataFrame, ids: list[int]) -> DataFrame:
    """Rows whose motif equals ``ids`` as a set, whatever the order."""
    names = motif_names(mined)
    return mined.filter(F.array_sort(F.array(*names)) == F.array(*(F.lit(int(i)) for i in sorted(ids))))


def distinct_set_counts(df: DataFrame, k: int) -> DataFrame:
    """In how many sequences each set of k different features occurs."""
    once = normalise(df, ORDINARY, contributions=False).withColumn("features", F.array_sort(F.array_distinct("features")))
    keys = [f"m{i}" for i in range(1, k + 1)]
    return enumerate_combinations(once, k, ORDINARY).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sequences"))


def count_histogram(counts: DataFrame, thresholds: list[int], column: str = "n_sequences") -> DataFrame:
    """How many keys reach each threshold."""
    steps = F.explode(F.array(*(F.lit(int(t)) for t in thresholds)))
    return counts.select(F.col(column), steps.alias("threshold")).groupBy("threshold").agg(F.sum((F.col(column) >= F.col("threshold")).cast("bigint")).alias("n_keys"))


def count_percentiles(counts: DataFrame, at: list[float], column: str = "n_sequences") -> DataFrame:
    return counts.agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").cast("bigint").alias(f"p{round(p * 100)}") for p in at))
