"""Nearest neighbours by shifted space-filling curves.

1. Vectors are projected by seeded random rotations, shifted, quantised and put
   on Hilbert curves; one ordering per curve. The quantiser's ranges come from a
   bounded sample (``SAMPLE`` vectors by hash of vec_id); every vector is indexed.
2. Spark range-partitions the orderings into windows of about ``WINDOW`` vectors.
   A query is compared with its own window and both neighbours on every curve;
   the results merge and are ranked by their exact scores.
How many of the true neighbours are found depends on the data and on the numbers
of curves and windows: clustered vectors need few curves; on isotropic ones a
query must be compared with a good part of the table. With one window the result
is exact.

Scores are inner products in double precision; ties go to the smaller vec_id. Of
equal vectors the ``k`` + 1 smallest vec_ids can be answers, so only these are
indexed; all ask. Null, zero and non-finite vectors and those of a length other
than the most common one take no part. A vec_id that repeats counts once, with
its smallest vector. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from combforge.llm.common import delete, shared_path, table, written

CURVES, AT_ONCE, DIMENSIONS, BITS = 21, 7, 6, 9  # curves in all, and laid out at once
WINDOW, SAMPLE = 1024, 4096
SEED = 11


def hilbert_key(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, d), by in-place Gray-code transposition."""
    x = x.T.astype(np.uint64).copy()
    d = len(x)
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > 1:
        low = q - np.uint64(1)
        for i in range(d):
            flip = (x[i] & q) > 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) > 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


class Curves:
    """Projections, shifts and ranges; fitted on a sample, applied to all."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dimensions: int = DIMENSIONS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        d = sample.shape[1]
        self.maps = [np.linalg.qr(draw.normal(size=(d, d)))[0][:, : min(dimensions, d)] for _ in range(curves)]
        self.shifts = [draw.uniform(0, 0.5, m.shape[1]) for m in self.maps]
        self.low = [(sample @ m).min(0) for m in self.maps]
        self.span = [np.maximum(np.ptp(sample @ m, axis=0), 1e-12) for m in self.maps]

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for m, s, low, span in zip(self.maps, self.shifts, self.low, self.span, strict=True):
            unit = np.clip((x @ m - low) / span, 0, 1) / 1.5 + s / 1.5  # shifted, within 0 to 1
            out.append(hilbert_key(np.minimum(unit * 2**BITS, 2**BITS - 1)))
        return out


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k nearest of x, the query itself left out."""
    out = []
    norm = np.sqrt((x * x).sum(1).max()) if len(x) else 0.0
    for at in range(0, len(q), 256):
        scores = q[at : at + 256] @ x.T
        scores[q_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        for i, s in enumerate(scores):
            n = min(k, len(s))
            edge = np.partition(s, len(s) - n)[len(s) - n]
            near = np.flatnonzero((s >= edge - 1e-12 * norm * np.sqrt(q[at + i] @ q[at + i])) & (s > -np.inf))
            exact = np.add.accumulate(x[near] * q[at + i], axis=1)[:, -1]  # left to right, whatever the block
            top = np.lexsort((ids[near], -exact))[:k]
            out.append((int(q_ids[at + i]), ids[near][top], exact[top]))
    return out


def _found(rows: list) -> pa.Table:
    n = [len(r[1]) for r in rows]
    return pa.table({"query_id": pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), n)), "vec_id": pa.array(np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64)), "score": pa.array(np.concatenate([r[2] for r in rows]) if rows else np.zeros(0))})


FOUND = "query_id BIGINT, vec_id BIGINT, score DOUBLE"


def _compare(rows: DataFrame, k: int) -> DataFrame:
    """rows: c, w, is_query, vec_id, v. Every query of a window of a curve against
    its vectors; memory holds one window and a batch of queries."""

    def run(batches):
        key, held, ids, x = None, [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            c, w, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            own, v = b.column(3).to_numpy(), _matrix(b.column(4))
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (w[1:] != w[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(c)], strict=True):
                if key != (c[lo], w[lo]):
                    key, held, x = (c[lo], w[lo]), [], None
                if not asks[lo]:
                    held.append((own[lo:hi], v[lo:hi]))
                elif held:
                    if x is None:
                        ids, x = (np.concatenate(y) for y in zip(*held, strict=True))
                    yield from _found(best(own[lo:hi], v[lo:hi], ids, x, k)).to_batches()

    return rows.repartition("c", "w").sortWithinPartitions("c", "w", "is_query").select("c", "w", "is_query", "vec_id", "v").mapInArrow(run, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", window: int = WINDOW, curves: int = CURVES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest other rows found.

    is_query: a condition on ``vec_id``.
    """
    spark, folder = vectors.sparkSession, shared_path(vectors.sparkSession)
    v = F.col(f"`{vector}`")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & fine)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE")
    rows = rows.filter(F.size("v") == sizes["d"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    same = Window.partitionBy("v").orderBy("vec_id")
    indexed = written(rows.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1).select("vec_id", "v"), f"{folder}/indexed")
    asking = written(rows.filter(is_query(F.col("vec_id"))), f"{folder}/asking")
    sample = np.array([r.v for r in indexed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()], np.float64)
    windows = -(-indexed.count() // window)
    both = indexed.withColumn("is_query", F.lit(False)).unionByName(asking.withColumn("is_query", F.lit(True)))
    found, kind = None, rows.schema["v"].dataType.simpleString()
    for start in range(0, 1 if windows == 1 else curves, AT_ONCE):
        of = 1 if windows == 1 else min(AT_ONCE, curves - start)
        shared = spark.sparkContext.broadcast(Curves(sample, of, seed=SEED + start))

        def index(batches, shared=shared, of=of):
            for b in batches:
                for c, keys in enumerate(shared.value.keys(_matrix(b.column(1))) if b.num_rows else []):
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.full(len(keys), c, np.int32)), pa.array(keys)], names=["vec_id", "v", "is_query", "c", "key"])

        keyed = both.mapInArrow(index, f"vec_id BIGINT, v {kind}, is_query BOOLEAN, c INT, key BIGINT")
        placed = keyed.repartitionByRange(windows * of, "c", "key", "vec_id").select("c", "is_query", "vec_id", "v", F.spark_partition_id().alias("w"))
        placed = written(placed, f"{folder}/placed-{start}")
        asks = placed.filter("is_query").withColumn("w", F.explode(F.array(F.col("w") - 1, F.col("w"), F.col("w") + 1)))
        part = _compare(placed.filter("NOT is_query").unionByName(asks), k)
        found = written(_top(part if found is None else found.select("query_id", "vec_id", "score").unionByName(part), k), f"{folder}/found-{start}")
        delete(spark, f"{folder}/placed-{start}")
    out = written(found.select("query_id", "rank", "vec_id", "score"))
    delete(spark, folder)
    return out


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


QUERIES = {"op6_neighbours": op6_neighbours}
ORACLE_SQL = {
    "op6_neighbours": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, v.v) DESC, v.vec_id) AS rank
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 20"""
}
