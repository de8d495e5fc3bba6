"""The staged mining API: count, select, extract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combforge.config import MiningConfig, require
from combforge.operators import combine, exact
from combforge.operators.partition import assign_buckets, bucket_ranges
from combforge.operators.sketch import CountMinSketch
from combforge.sources import CONVOLUTION, infer_case, normalise, validate


class MiningPlan:
    """A lazy plan; every method returns a DataFrame and runs nothing.

    The exception is ``max_combinations``: when set, one aggregate predicts the
    enumeration before the plan is built.
    """

    def __init__(self, df: DataFrame, config: MiningConfig):
        self.config = config
        self.case = infer_case(df)
        require(self.case != CONVOLUTION or config.filter_len is not None, "positional features need filter_len")
        self.keys = combine.key_columns(config.motif_size, self.case)
        self._df = df
        if config.max_combinations is not None:
            combine.guard(normalise(df, self.case, contributions=False), config.motif_size, config.max_combinations)

    def _sequences(self, contributions: bool) -> DataFrame:
        out = normalise(self._df, self.case, contributions)
        return assign_buckets(out, self.config.partition_width) if self._bucketed else out

    @property
    def _bucketed(self) -> bool:
        return self.config.count_scope != "global"

    def _enumerate(self, contributions: bool) -> DataFrame:
        c = self.config
        build = combine.enumerate_by_join if c.plan == "join" else combine.enumerate_combinations
        return build(self._sequences(contributions), c.motif_size, self.case, c.filter_len, c.overlap, ("bucket",) if self._bucketed else ())

    def occurrences(self) -> DataFrame:
        """All combinations, before selection."""
        return self._enumerate(True)

    def sketch(self) -> CountMinSketch:
        c = self.config
        return CountMinSketch.build(self.keys, c.delta, c.epsilon, c.seed)

    def count(self) -> DataFrame:
        """Exact counts by key (and bucket, when the scope is not global)."""
        return exact.scoped_counts(self._enumerate(False), self.keys, self.config.count_scope)[0]

    def cells(self) -> DataFrame:
        """Cells of the sketch over the whole input; no key is counted exactly."""
        return self.sketch().count(self._enumerate(False))

    def _probed(self, contributions: bool) -> DataFrame:
        """Occurrences whose estimate reaches min_count, with ``est``."""
        found = self.sketch().probe(self._enumerate(contributions), self.cells(), self.config.cms_rows_used)
        return found.filter(F.col("est") >= self.config.min_count)

    def estimates(self) -> DataFrame:
        return self.sketch().probe(self._enumerate(False).select(*self.keys).distinct(), self.cells(), self.config.cms_rows_used)

    def select(self) -> DataFrame:
        """Selected keys with their count; under "cms" the count is the estimate.

        Under "cms_verified" only occurrences whose estimate passes are counted.
        """
        c = self.config
        if c.method == "exact":
            return self.count().filter(F.col("count") >= c.min_count)
        require(c.count_scope == "global", "sketch methods count over the whole input")
        if c.method == "cms":
            return self._probed(False).groupBy(*self.keys).agg(F.max("est").alias("count"))
        return exact.count_keys(self._probed(False), self.keys).filter(F.col("count") >= c.min_count)

    def extract(self) -> DataFrame:
        """Every occurrence of a selected key, with ``count`` as the last column."""
        c = self.config
        on = [*self.keys, "bucket"] if self._bucketed else self.keys
        if c.method == "cms" and not self._bucketed:
            rows = self._probed(True).withColumnRenamed("est", "count")
        else:
            likely = self._probed(True).drop("est") if c.method == "cms_verified" and not self._bucketed else self.occurrences()
            rows = exact.select_frequent(likely, self.select(), on, c.min_count)
        place = ["start", "end"] if self.case == CONVOLUTION else []
        return rows.select(*self.keys, *place, "data_index", "contribution", "count")


class PartitionedPlan(MiningPlan):
    """Mining with length buckets; an input without sequences is an error."""

    def __init__(self, df: DataFrame, config: MiningConfig):
        validate(df)
        super().__init__(df, config)

    def ranges(self) -> DataFrame:
        """Non-empty buckets with their length range and number of sequences."""
        return bucket_ranges(normalise(self._df, self.case, contributions=False), self.config.partition_width)

    def statistics(self) -> str:
        """Ranges, sizes and the sketch that all buckets share; a row per bucket
        reaches the driver."""
        c, sketch = self.config, self.sketch()
        head = [f"case {self.case}, motif size {c.motif_size}, filter length {c.filter_len}, batch size {c.batch_size}", f"sketch {sketch.describe()}"]
        return "\n".join([*head, *(f"bucket {r.bucket}: lengths {r.lo} to {r.hi}, {r.n_sequences} sequences" for r in self.ranges().orderBy("bucket").collect())])


def mine_motifs(df: DataFrame, motif_size: int | None = None, filter_len: int | None = None, min_count: int | None = None, config: MiningConfig | None = None, **more) -> DataFrame:
    """Every occurrence of every K-combination found at least ``min_count`` times.

    Keywords override ``config``. The result is empty, with its schema, when no
    sequence is long enough; an input without rows is an error.
    """
    validate(df)
    config = (config or MiningConfig()).with_(motif_size=motif_size, filter_len=filter_len, min_count=min_count, **more)
    return MiningPlan(df, config).extract()


def mine_motifs_partitioned(df: DataFrame, partition_width: int = 10, count_scope: str = "global", **more) -> DataFrame:
    """Mining with length buckets; see ``scoped_counts`` for the scopes."""
    return mine_motifs(df, partition_width=partition_width, count_scope=count_scope, **more)
