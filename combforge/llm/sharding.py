"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows of a source are put in seeded order; a row's fractional rank is its rank
over the source's size. All rows sorted by fractional rank are cut into shards
of equal counts, so every shard holds each source in proportion.

Both ranks are distributed: rows fall into steps by hash (by fractional rank the
second time), counts of steps give offsets, and only a step is sorted within a
task. A hot source is spread over all steps; there is a step for every 16,384
rows, from 4,096 to 2^20 steps.

Null text has 8 bytes of size and CRC 0; a null source is a source of its own;
null doc_ids and repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from combforge.llm.common import table, unit_hash

SHARDS = 24
SEED = "shard-1"


def interleave(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", source: str = "source", steps: int | None = None, seed: str = SEED) -> DataFrame:
    """``row`` (the input columns), shard (from 0), slot (gapless from 0 in a shard).

    steps: a power of two.
    """
    if steps is None:
        steps = min(1 << 20, max(4096, 1 << (docs.count() >> 14).bit_length()))
    src = F.col(f"`{source}`").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("id"), src.isNull().alias("no_source"), F.coalesce(src, F.lit("")).alias("source"), unit_hash(seed, F.col(f"`{doc_id}`")).alias("h"))
    rows = rows.withColumn("step", F.shiftright("h", 52 - (steps - 1).bit_length()).cast("int"))
    by = ["no_source", "source"]
    counts = rows.groupBy(*by, "step").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy(*by)
    counts = counts.select(*by, "step", F.sum("n").over(of).alias("of"), F.coalesce(F.sum("n").over(of.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    rows = rows.join(counts, [*by, "step"])
    rank = F.col("offset") + F.row_number().over(Window.partitionBy(*by, "step").orderBy("h", "id")) - 1
    rows = rows.withColumn("fraction", (2 * rank + 1).cast("double") / (2 * F.col("of")).cast("double"))
    rows = rows.withColumn("cut", F.floor(F.col("fraction") * steps).cast("int"))
    cuts = rows.groupBy("cut").agg(F.count(F.lit(1)).alias("n"))  # `steps` rows at most
    cuts = cuts.select("cut", F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"), F.coalesce(F.sum("n").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("from"))
    rows = rows.join(F.broadcast(cuts), "cut")
    place = F.col("from") + F.row_number().over(Window.partitionBy("cut").orderBy("fraction", *by, "h", "id")) - 1
    rows = rows.withColumn("place", place)
    rows = rows.withColumn("shard", F.expr(f"CAST((place * {shards}) DIV total AS INT)"))
    first = F.expr(f"(shard * total + {shards - 1}) DIV {shards}")
    return rows.select("row", "shard", (F.col("place") - first).cast("bigint").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    return interleave(docs).select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLE_SQL = {
    # The CRC is reduced byte by byte over the table of the reflected polynomial.
    "op10_sharding": rf"""
WITH t AS (SELECT list(c ORDER BY b) AS crc FROM (
  SELECT b, list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, {0xEDB88320}) ELSE a // 2 END, b) AS c FROM range(256) r(b))),
d AS (SELECT doc_id, source, encode(coalesce(text, '')) AS body, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS h FROM documents),
c AS (SELECT doc_id, source, h, octet_length(body) + 8 AS size, xor({2**32 - 1}, list_reduce(list_transform(regexp_extract_all(hex(body), '..'),
  lambda x: CAST('0x' || x AS BIGINT)), lambda a, b: xor(a >> 8, crc[xor(a % 256, b) + 1]), {2**32 - 1})) AS text_crc32 FROM d, t),
f AS (SELECT *, CAST(2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST) - 1 AS DOUBLE) / (2 * count(*) OVER (PARTITION BY source)) AS fraction FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS LAST, h, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM f),
s AS (SELECT *, place * {SHARDS} // total AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(place - (shard * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""
}
