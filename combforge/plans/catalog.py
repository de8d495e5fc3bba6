"""Registered queries of the mining engine, each with its SQL for DuckDB.

Baskets: an order's suppliers (folded to 100 ids) weighted by price.
Tracks: a user's events by hour, the event type as filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combforge.config import MiningConfig
from combforge.functions import memory, post
from combforge.operators.partition import assign_buckets, bucket_ranges
from combforge.operators.sketch import CountMinSketch
from combforge.plans.mine import MiningPlan, mine_motifs
from combforge.sources import ORDINARY, length_stats, make_conv_feature, merge_duplicates, normalise

Query = Callable[[SparkSession, str], DataFrame]

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
HOUR = 3600
EPOCH = "2024-01-01 00:00:00"
SMALL = {"delta": 0.05, "epsilon": 0.003}  # a sketch small enough to overcount


def baskets(spark: SparkSession, sf_dir: str, zero: bool = False) -> DataFrame:
    supplier = F.col("l_suppkey") % 100 + (0 if zero else 1)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("data_index"), supplier.cast("int").alias("feature"), F.col("l_extendedprice").cast("float").alias("contribution"))


def tracks(spark: SparkSession, sf_dir: str, by_day: bool = False) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit(EPOCH).cast("timestamp"))
    index = F.col("user_id") * 100 + F.dayofmonth("ts") if by_day else F.col("user_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        index.cast("bigint").alias("data_index"),
        F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("int").alias("filter"),
        F.col("value").cast("float").alias("contribution"),
        F.floor(seconds / HOUR).cast("int").alias("position"),
        F.col("event_id").cast("bigint").alias("ordinal"),
    )


BASKETS = "b AS (SELECT l_orderkey AS data_index, CAST(1 + l_suppkey % 100 AS INTEGER) AS f, CAST(l_extendedprice AS FLOAT) AS c FROM lineitem)"
ROWS = "r AS (SELECT *, row_number() OVER (PARTITION BY data_index ORDER BY f, c) AS i FROM b WHERE f <> 0)"
TYPES = ", ".join(f"'{t}'" for t in EVENT_TYPES)


def _tracks(by_day: bool) -> str:
    index = "user_id * 100 + day(CAST(ts AS TIMESTAMP))" if by_day else "user_id"
    return (
        f"b AS (SELECT CAST({index} AS BIGINT) AS data_index, CAST(list_position([{TYPES}], event_type) AS INTEGER) AS f, CAST(value AS FLOAT) AS c, "
        f"CAST(floor((epoch(CAST(ts AS TIMESTAMP)) - epoch(TIMESTAMP '{EPOCH}')) / {HOUR}) AS INTEGER) AS p, event_id FROM events), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY data_index ORDER BY p, event_id, f, c) AS i FROM b)"
    )


def _occurrences(k: int, filter_len: int | None = None, reject: bool = True, more: str = "") -> str:
    conv = filter_len is not None
    out = [f"a{i}.f AS m{i}" for i in range(1, k + 1)]
    if conv:
        out += [f"a{i + 1}.p - a{i}.p - {filter_len} AS d{i}{i + 1}" for i in range(1, k)]
        out += ['a1.p AS "start"', f'a{k}.p + {filter_len - 1} AS "end"']
    out += ["a1.data_index AS data_index", "CAST(0 AS FLOAT) + " + " + ".join(f"a{i}.c" for i in range(1, k + 1)) + " AS contribution"]
    joins = "".join(f" JOIN r a{i} ON a{i}.data_index = a1.data_index AND a{i - 1}.i < a{i}.i" + (f" AND a{i}.p - a{i - 1}.p >= {filter_len}" if conv and reject else "") for i in range(2, k + 1))
    return f"occ AS (SELECT {', '.join(out)}{more} FROM r a1{joins})"


def _keys(k: int, conv: bool) -> list[str]:
    return [f"m{i}" for i in range(1, k + 1)] + [f"d{i}{i + 1}" for i in range(1, k)] * conv


def _mined(source: str, k: int, at_least: int, filter_len: int | None = None, reject: bool = True) -> str:
    keys = ", ".join(_keys(k, filter_len is not None))
    return f"WITH {source}, {_occurrences(k, filter_len, reject)}, mined AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS count FROM occ QUALIFY count(*) OVER (PARTITION BY {keys}) >= {at_least})"


def _ordinary(k: int, at_least: int) -> str:
    return _mined(f"{BASKETS}, {ROWS}", k, at_least)


def _scoped(window: str) -> str:
    buckets = "sized AS (SELECT *, count(*) OVER (PARTITION BY data_index) AS n FROM b), r AS (SELECT *, (n - (SELECT min(n) FROM sized)) // 3 AS bucket, row_number() OVER (PARTITION BY data_index ORDER BY f, c) AS i FROM sized)"
    over = f"count(*) OVER (PARTITION BY {window})"
    return f"WITH {BASKETS}, {buckets}, {_occurrences(2, more=', a1.bucket AS bucket')} SELECT m1, m2, data_index, contribution, {over} AS count FROM occ QUALIFY {over} >= 20"


def _scope_query(scope: str) -> Query:
    return lambda s, d: mine_motifs(baskets(s, d), 2, min_count=20, count_scope=scope, partition_width=3)


def _plan(method: str = "exact", rows_used: str = "all", min_count: int = 40) -> Callable[[SparkSession, str], MiningPlan]:
    return lambda s, d: MiningPlan(baskets(s, d), MiningConfig(motif_size=2, min_count=min_count, method=method, cms_rows_used=rows_used, **SMALL))


def _conv_plan(s: SparkSession, d: str) -> MiningPlan:
    return MiningPlan(tracks(s, d, True), MiningConfig(motif_size=2, filter_len=1, **SMALL))


def _cells(k: int, conv: bool, first: bool = False) -> str:
    """CTEs n (keys and counts), cells, and est (keys and estimate)."""
    keys = _keys(k, conv)
    sketch = CountMinSketch.build(keys, SMALL["delta"], SMALL["epsilon"], 1)
    rows = range(1 if first else sketch.rows)
    h = lambda r: " + ".join(f"CAST({x} AS BIGINT) * {c}" for x, c in zip(keys, sketch.coefficients[r], strict=True))
    addressed = " UNION ALL ".join(f"SELECT *, {r} AS \"row\", ((({h(r)}) % {sketch.cols}) + {sketch.cols}) % {sketch.cols} AS col FROM n" for r in rows)
    names = ", ".join(keys)
    return f'n AS (SELECT {names}, count(*) AS n FROM occ GROUP BY {names}), addressed AS ({addressed}), cells AS (SELECT "row", col, CAST(sum(n) AS BIGINT) AS cnt FROM addressed GROUP BY "row", col), est AS (SELECT {names}, min(cnt) AS est FROM addressed JOIN cells USING ("row", col) GROUP BY {names})'


def _with_cells(first: bool = False) -> str:
    return f"WITH {BASKETS}, {ROWS}, {_occurrences(2)}, {_cells(2, False, first)}"


CMS_SELECT = " SELECT occ.*, est AS count FROM occ JOIN est USING (m1, m2) WHERE est >= 9000"
LENGTHS = "lens AS (SELECT data_index, count(*) AS n FROM b WHERE f <> 0 GROUP BY data_index)"


def _one(column: str, value: Callable[[int], int]) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        longest = normalise(baskets(s, d), ORDINARY, contributions=False).agg(F.max(F.size("features"))).first()[0]
        return s.createDataFrame([(value(longest),)], f"{column} BIGINT")

    return run


def _auto(s: SparkSession, d: str) -> DataFrame:
    found = memory.auto_configure(baskets(s, d), 3, target_memory_gb=0.005)
    return s.createDataFrame([(found["batch_size"], found["num_batches"], found["total_data_points"], found["max_active_len"])], "batch_size BIGINT, num_batches BIGINT, total_data_points BIGINT, max_active_len BIGINT")


def _auto_memory(s: SparkSession, d: str) -> DataFrame:
    found = memory.auto_configure(baskets(s, d), 3, target_memory_gb=0.005)
    names = ("memory_per_point_kb", "memory_per_batch_mb", "fixed_memory_mb", "estimated_peak_memory_gb")
    return s.createDataFrame([tuple(float(found[n]) for n in names)], ", ".join(f"{n} DOUBLE" for n in names))


_ROWS = math.ceil(math.log(1 / 1e-4))
_COLS = math.ceil(math.e / 5e-5)
_C3 = "(max(n) * (max(n) - 1) * (max(n) - 2) // 6)"
_FIXED = f"(4 * (3 * {_C3} + {_ROWS * _COLS} + {_ROWS * 3}))"
_POINT = f"(max(n) * 12 + {_C3})"
_BATCH = f"greatest(10, least(({math.floor(0.005 * 1024**3)} - {_FIXED}) // {_POINT}, 10000, count(*)))"

_PEAK = f"CAST({_FIXED} + {_POINT} * {_BATCH} AS DOUBLE)"

CATALOG: dict[str, tuple[Query, str]] = {
    **{f"ord_k{k}": ((lambda s, d, k=k, n=n: mine_motifs(baskets(s, d), k, min_count=n)), _ordinary(k, n) + " SELECT * FROM mined") for k, n in ((1, 100), (2, 30), (3, 5), (4, 2), (5, 2))},
    "conv_k1": (lambda s, d: mine_motifs(tracks(s, d), 1, filter_len=8, min_count=50), _mined(_tracks(False), 1, 50, 8) + " SELECT * FROM mined"),
    "conv_k2_reject": (lambda s, d: mine_motifs(tracks(s, d), 2, filter_len=8, min_count=40), _mined(_tracks(False), 2, 40, 8) + " SELECT * FROM mined"),
    "conv_k2_allow": (lambda s, d: mine_motifs(tracks(s, d), 2, filter_len=8, min_count=40, overlap="allow"), _mined(_tracks(False), 2, 40, 8, False) + " SELECT * FROM mined"),
    "conv_k3_day": (lambda s, d: mine_motifs(tracks(s, d, True), 3, filter_len=1, min_count=3), _mined(_tracks(True), 3, 3, 1) + " SELECT * FROM mined"),
    "ord_zero_sentinel": (lambda s, d: mine_motifs(baskets(s, d, zero=True), 2, min_count=20), _ordinary(2, 20).replace("1 + l_suppkey % 100", "l_suppkey % 100") + " SELECT * FROM mined"),
    "ord_dedup_k2": (
        lambda s, d: mine_motifs(merge_duplicates(baskets(s, d).withColumn("contribution", F.col("contribution").cast("decimal(12,2)"))), 2, min_count=30),
        _ordinary(2, 30).replace(f"{BASKETS}, {ROWS}", f"b0{BASKETS[1:]}, b AS (SELECT data_index, f, CAST(sum(CAST(c AS DECIMAL(12,2))) AS FLOAT) AS c FROM b0 GROUP BY data_index, f), {ROWS}") + " SELECT * FROM mined",
    ),
    "distinct_set_counts": (
        lambda s, d: post.distinct_set_counts(baskets(s, d), 2),
        f"WITH {BASKETS}, s AS (SELECT DISTINCT data_index, f FROM b) SELECT x.f AS m1, y.f AS m2, count(*) AS n_sequences FROM s x JOIN s y ON x.data_index = y.data_index AND x.f < y.f GROUP BY x.f, y.f",
    ),
    "set_count_histogram": (
        lambda s, d: post.count_histogram(post.distinct_set_counts(baskets(s, d), 2), [1, 20, 25, 30]),
        f"WITH {BASKETS}, s AS (SELECT DISTINCT data_index, f FROM b), n AS (SELECT count(*) AS n FROM s x JOIN s y ON x.data_index = y.data_index AND x.f < y.f GROUP BY x.f, y.f) SELECT t AS threshold, CAST(sum(CASE WHEN n >= t THEN 1 ELSE 0 END) AS BIGINT) AS n_keys FROM n, (VALUES (1), (20), (25), (30)) v(t) GROUP BY t",
    ),
    "set_count_percentiles": (
        lambda s, d: post.count_percentiles(post.distinct_set_counts(baskets(s, d), 2), [0.5, 0.9, 0.99]),
        f"WITH {BASKETS}, s AS (SELECT DISTINCT data_index, f FROM b), n AS (SELECT count(*) AS n FROM s x JOIN s y ON x.data_index = y.data_index AND x.f < y.f GROUP BY x.f, y.f) SELECT quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.99) AS p99 FROM n",
    ),
    "count_filter": (lambda s, d: post.filter_count(mine_motifs(baskets(s, d), 2), 35), _ordinary(2, 1) + " SELECT * FROM mined WHERE count >= 35"),
    "motif_as_set": (lambda s, d: post.containing_set(mine_motifs(baskets(s, d), 2), [17, 4]), _ordinary(2, 1) + " SELECT * FROM mined WHERE m1 = 4 AND m2 = 17"),
    "unique_motifs": (lambda s, d: post.unique_motifs(mine_motifs(baskets(s, d), 2, min_count=20)), _ordinary(2, 20) + " SELECT m1, m2, max(count) AS count FROM mined GROUP BY m1, m2"),
    "motif_stats_topn": (
        lambda s, d: post.top_motifs(post.motif_stats(mine_motifs(baskets(s, d), 2, min_count=20)).withColumn("mean_contribution", F.round("mean_contribution", 2)), 25),
        _ordinary(2, 20) + " SELECT m1, m2, max(count) AS count, round(avg(CAST(contribution AS DOUBLE)), 2) AS mean_contribution FROM mined GROUP BY m1, m2 ORDER BY count DESC, m1, m2 LIMIT 25",
    ),
    "length_stats": (lambda s, d: length_stats(normalise(baskets(s, d), contributions=False)), f"WITH {BASKETS}, {LENGTHS} SELECT count(*) AS n_sequences, CAST(min(n) AS INTEGER) AS min_len, CAST(max(n) AS INTEGER) AS max_len, avg(n) AS mean_len FROM lens"),
    "length_buckets": (
        lambda s, d: assign_buckets(normalise(baskets(s, d), contributions=False), 3).select("data_index", F.size("features").alias("n"), "bucket"),
        f"WITH {BASKETS}, {LENGTHS} SELECT data_index, CAST(n AS INTEGER) AS n, CAST((n - (SELECT min(n) FROM lens)) // 3 AS INTEGER) AS bucket FROM lens",
    ),
    "bucket_ranges": (
        lambda s, d: bucket_ranges(normalise(baskets(s, d), contributions=False), 3),
        f"WITH {BASKETS}, {LENGTHS}, e AS (SELECT min(n) AS lo, max(n) AS hi FROM lens) SELECT CAST((n - lo) // 3 AS INTEGER) AS bucket, CAST(any_value(lo) + 3 * ((n - lo) // 3) AS INTEGER) AS lo, CAST(least(any_value(lo) + 3 * ((n - lo) // 3) + 2, any_value(hi)) AS INTEGER) AS hi, count(*) AS n_sequences, CAST(min(n) AS INTEGER) AS min_len, CAST(max(n) AS INTEGER) AS max_len FROM lens, e GROUP BY (n - lo) // 3",
    ),
    "part_global": (_scope_query("global"), _scoped("m1, m2")),
    "part_prefix": (_scope_query("prefix"), _scoped("m1, m2 ORDER BY bucket RANGE UNBOUNDED PRECEDING")),
    "part_local": (_scope_query("partition"), _scoped("m1, m2, bucket")),
    "cms_cells_ord": (lambda s, d: _plan()(s, d).cells(), _with_cells() + ' SELECT "row", col, cnt FROM cells'),
    "cms_cells_conv": (lambda s, d: _conv_plan(s, d).cells(), f'WITH {_tracks(True)}, {_occurrences(2, 1)}, {_cells(2, True)} SELECT "row", col, cnt FROM cells'),
    "cms_estimate_min": (lambda s, d: _plan()(s, d).estimates(), _with_cells() + " SELECT m1, m2, est FROM est"),
    "cms_estimate_row1": (lambda s, d: _plan(rows_used="first")(s, d).estimates(), _with_cells(True) + " SELECT m1, m2, est FROM est"),
    "cms_select_min": (lambda s, d: _plan("cms", min_count=120)(s, d).extract(), _with_cells() + CMS_SELECT.replace("9000", "120")),
    "cms_select_row1": (lambda s, d: _plan("cms", "first", 240)(s, d).extract(), _with_cells(True) + CMS_SELECT.replace("9000", "240")),
    "cms_verified": (lambda s, d: _plan("cms_verified", min_count=30)(s, d).extract(), _ordinary(2, 30) + " SELECT * FROM mined"),
    "mem_per_point": (_one("bytes", lambda n: memory.per_point_bytes(n, 3, ORDINARY)), f"WITH {BASKETS}, {LENGTHS} SELECT CAST({_POINT} AS BIGINT) AS bytes FROM lens"),
    "mem_fixed": (_one("bytes", lambda n: memory.fixed_bytes(n, 3, ORDINARY)), f"WITH {BASKETS}, {LENGTHS} SELECT CAST({_FIXED} AS BIGINT) AS bytes FROM lens"),
    "auto_batch": (_auto, f"WITH {BASKETS}, {LENGTHS} SELECT CAST({_BATCH} AS BIGINT) AS batch_size, CAST(ceil(count(*) / {_BATCH}) AS BIGINT) AS num_batches, count(*) AS total_data_points, CAST(max(n) AS BIGINT) AS max_active_len FROM lens"),
    "auto_batch_memory": (_auto_memory, f"WITH {BASKETS}, {LENGTHS} SELECT CAST({_POINT} AS DOUBLE) / 1024 AS memory_per_point_kb, {_PEAK} / 1048576 AS memory_per_batch_mb, CAST({_FIXED} AS DOUBLE) / 1048576 AS fixed_memory_mb, {_PEAK} / 1073741824 AS estimated_peak_memory_gb FROM lens"),
    "ord_k2_join": (lambda s, d: mine_motifs(baskets(s, d), 2, min_count=30, plan="join"), _ordinary(2, 30) + " SELECT * FROM mined"),
    "conv_make_feature": (
        lambda s, d: tracks(s, d).select("data_index", make_conv_feature(F.col("filter"), F.col("contribution"), F.col("position")).alias("x")).groupBy("x.filter").agg(F.count("*").alias("n"), F.min("x.position").alias("first"), F.max("x.position").alias("last")),
        f'WITH {_tracks(False)} SELECT f AS filter, count(*) AS n, min(p) AS first, max(p) AS last FROM r GROUP BY f',
    ),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_motifs(baskets(spark, sf_dir), 2, min_count=200)
