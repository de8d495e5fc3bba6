"""Count-Min Sketch as a table of cells (row, col, cnt).

The table holds at most rows * cols cells whatever the input, and two sketches
with the same parameters merge by adding cells. An estimate never falls below
the exact count.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combforge.config import DEFAULT_DELTA, DEFAULT_EPSILON, require
from combforge.sources import CONVOLUTION, ORDINARY

#: Cells beyond which the table is joined by shuffle (24 bytes a cell).
BROADCAST_CELLS = 1_000_000


def sketch_rows(delta: float = DEFAULT_DELTA) -> int:
    return math.ceil(math.log(1 / delta))


def sketch_counters(rows: int, epsilon: float = DEFAULT_EPSILON) -> int:
    return rows * math.ceil(math.e / epsilon)


def sketch_cols(counters: int, rows: int) -> int:
    return counters // rows


def hash_width(k: int, case: str) -> int:
    """Key slots of a motif: ids, and for positional features distances too."""
    require(case in (ORDINARY, CONVOLUTION), "unknown case")
    return 2 * k - 1 if case == CONVOLUTION else k


@dataclass(frozen=True)
class CountMinSketch:
    """Parameters and hash coefficients; immutable and cheap to ship."""

    keys: tuple[str, ...]
    rows: int
    cols: int
    coefficients: tuple[tuple[int, ...], ...]

    @classmethod
    def build(cls, keys: list[str], delta: float = DEFAULT_DELTA, epsilon: float = DEFAULT_EPSILON, seed: int = 1) -> CountMinSketch:
        require(len(keys) > 0, "a sketch needs at least one key column")
        require(0 < delta < 1 and 0 < epsilon < 1, "delta and epsilon must be in (0, 1)")
        rows = sketch_rows(delta)
        counters = sketch_counters(rows, epsilon)
        draw = random.Random(seed)
        return cls(tuple(keys), rows, sketch_cols(counters, rows), tuple(tuple(draw.randint(1, counters - 1) for _ in keys) for _ in range(rows)))

    @property
    def size(self) -> tuple[int, int]:
        return self.rows, self.cols

    def cell(self, row: int) -> Column:
        total = F.lit(0).cast("bigint")
        for name, c in zip(self.keys, self.coefficients[row], strict=True):
            total = total + F.col(name).cast("bigint") * F.lit(c).cast("bigint")
        return F.pmod(total, F.lit(self.cols).cast("bigint"))

    def _addressed(self, df: DataFrame, *keep: str) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(r).alias("row"), self.cell(r).alias("col")) for r in range(self.rows)))
        return df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.row", "cell.col")

    def describe(self) -> str:
        return f"{self.rows} x {self.cols} counters over {', '.join(self.keys)}"

    def lookup(self, cells: DataFrame, row: int, col: int) -> int:
        """The counter at (row, col), both from 0; cells that hold nothing are 0."""
        require(0 <= row < self.rows and 0 <= col < self.cols, "no such cell")
        found = cells.filter((F.col("row") == row) & (F.col("col") == col)).first()
        return found["cnt"] if found else 0

    def count(self, occurrences: DataFrame) -> DataFrame:
        """Cells straight from occurrences: each task sends rows * cols partial
        counts at most, whatever the number of keys."""
        return self._addressed(occurrences).groupBy("row", "col").agg(F.count(F.lit(1)).alias("cnt"))

    def probe(self, df: DataFrame, cells: DataFrame, rows_used: str = "all") -> DataFrame:
        """Adds ``est`` to every row of df, without a shuffle of df: the counters
        are one broadcast array (a sketch beyond BROADCAST_CELLS is joined)."""
        rows = 1 if rows_used == "first" else self.rows
        if self.rows * self.cols > BROADCAST_CELLS:
            return df.join(self.estimate(df.select(*self.keys).distinct(), cells, rows_used), list(self.keys))
        place = (F.col("row") * self.cols + F.col("col")).alias("place")
        zeros = df.sparkSession.range(rows * self.cols).select(F.col("id").alias("place"), F.lit(0).cast("bigint").alias("cnt"))
        dense = cells.filter(F.col("row") < rows).select(place, "cnt").unionByName(zeros).groupBy("place").agg(F.sum("cnt").alias("cnt"))
        counters = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "cnt"))), lambda x: x["cnt"]).alias("counters"))
        ests = [F.get("counters", (self.cell(r) + r * self.cols).cast("int")) for r in range(rows)]
        est = F.least(*ests) if rows > 1 else ests[0]
        return df.crossJoin(F.broadcast(counters)).select(*df.columns, est.alias("est"))

    def update(self, counts: DataFrame) -> DataFrame:
        """Cells of pre-aggregated counts (keys, count)."""
        return self._addressed(counts, "count").groupBy("row", "col").agg(F.sum("count").alias("cnt"))

    @staticmethod
    def merge(*cells: DataFrame) -> DataFrame:
        both = cells[0]
        for more in cells[1:]:
            both = both.unionByName(more)
        return both.groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))

    def estimate(self, keys: DataFrame, cells: DataFrame, rows_used: str = "all") -> DataFrame:
        """Point queries: distinct keys with their estimated count.

        rows_used: "all" takes the minimum over the rows, "first" row 0 only.
        """
        asked = self._addressed(keys, *self.keys)
        if rows_used == "first":
            asked = asked.filter("row = 0")
        table = F.broadcast(cells) if self.rows * self.cols <= BROADCAST_CELLS else cells
        return asked.join(table, ["row", "col"]).groupBy(*self.keys).agg(F.min("cnt").alias("est"))
