"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each row draws an exponential key scaled by its quality weight. Within a source
rows are taken in key order up to a token budget; a budget of several times the
source is first spent on complete epochs, and only the rest is a selection.

The prefix sums are distributed: keys fall into steps of equal counts, whatever
the weights, the sums of (source, step) give offsets, and only inside a step are
rows sorted. A hot source is thus spread over all steps. The steps are runs of
``CELLS`` logarithmic cells an octave, and a cell holds at most 1 in 16,000 of
the rows. There is a step for every ``STEP_ROWS`` rows, ``buckets`` at least.

Null text has size 0. A null source is a source of its own, last in order. A
null, non-positive or infinite quality weighs ``default_weight``. Repeated rows are rows
of their own. The document that straddles a budget is taken if at least half of
it fits, so a source misses its target by half a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from combforge.llm.common import table, unit_hash

SEED = "mix-1"
MAX_EPOCHS = 3
CELLS = 4096  # an octave of the keys
STEP_ROWS = 50_000
DEFAULT_WEIGHT = 0.5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(rows: DataFrame) -> DataFrame:
    """Source targets from (no_source, source, size): one row per source.

    Weights are 1, 2, 3 in turn. Water-filling in closed form: sources by size
    per weight; the smallest number of capped ones after which the level fits
    the next. Windows here run over the table of sources alone.
    """
    s = rows.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", (F.row_number().over(Window.orderBy("no_source", "source")) - 1) % 3 + 1)
    order = Window.orderBy(F.col("source_size") / F.col("w"), "no_source", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    s = s.select("*", F.row_number().over(order).alias("r"), F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.sum("source_size").over(everything).alias("st"), F.sum("w").over(everything).alias("wt"))
    level = (F.col("st") - MAX_EPOCHS * F.col("s0")) / (F.col("wt") - F.col("w0"))
    s = s.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= MAX_EPOCHS * F.col("source_size"))
    s = s.select("*", F.min(F.when(F.col("fits"), F.struct("r", "level"))).over(everything).alias("cut"))
    target = F.when(F.col("r") < F.col("cut.r"), (MAX_EPOCHS * F.col("source_size")).cast("double")).otherwise(F.col("cut.level") * F.col("w"))
    return s.select("no_source", "source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def even_steps(rows: DataFrame, least: int) -> DataFrame:
    """(cell, step): runs of cells with about equal counts of rows.

    Keys lie between 2^-53 and 2^6 over the weight, so there are at most some
    60 * CELLS cells for each octave of weights; half of all keys lie in two octaves.
    """
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("cell", before.alias("before"), F.sum("n").over(everything).alias("of"))
    steps = F.greatest(F.lit(least), F.col("of") / STEP_ROWS)
    return cells.select("cell", F.floor(F.col("before") * steps / F.col("of")).cast("int").alias("step"))


def mix(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", buckets: int = 1024, seed: str = SEED, default_weight: float = DEFAULT_WEIGHT, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``row`` (the columns of ``keep``), size,
    source_size, target, copies (how often the mix takes it), taken.

    weights: (doc_id, weight), optional; of several rows for a document the
    largest counts.
    """
    keep = docs.columns if keep is None else keep
    src = F.col(f"`{source}`").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{doc_id}`").alias("id"), src.isNull().alias("no_source"), F.coalesce(src, F.lit("")).alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    goals = targets(rows)
    if weights is None:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    else:
        w = weights.groupBy(F.col("doc_id").alias("wid")).agg(F.max("weight").alias("weight"))
        rows = rows.join(w, F.col("id") == F.col("wid"), "left").drop("wid")
    weight = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight").cast("double")).otherwise(F.lit(float(default_weight)))
    u = (unit_hash(seed, F.col("id")) + F.lit(0.5)) / F.lit(float(2**52))
    rows = rows.withColumn("key", -F.log(u) / weight)
    rows = rows.withColumn("cell", F.coalesce(F.floor(F.log2("key") * CELLS), F.lit(-64 * CELLS)).cast("int"))
    rows = rows.join(F.broadcast(even_steps(rows, buckets)), "cell")
    by = ["no_source", "source"]
    steps = rows.groupBy(*by, "step").agg(F.sum("size").alias("step_size"))
    running = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*by, "step", F.coalesce(F.sum("step_size").over(running), F.lit(0)).alias("offset")).join(goals, by)
    rows = rows.join(steps, [*by, "step"])
    inside = Window.partitionBy(*by, "step").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.col("offset") + F.sum("size").over(inside))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = F.col("target") - epochs * F.col("source_size")
    copies = epochs + (2 * F.col("upto") - F.col("size") <= 2 * rest).cast("bigint")
    copies = F.least(F.when(F.col("size") > 0, copies).otherwise(F.lit(1)), F.lit(MAX_EPOCHS)).cast("bigint")
    return rows.select("row", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def repeated(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns.

    Copies are decided on ids, sources and sizes alone; texts are shuffled once,
    to meet the decision. Rows equal in all three share it: if the budget ends
    among them, the first by text hash get the copy more.
    """
    body, label = (F.col(f"`{c}`") for c in (text, source))
    narrow = docs.select(F.col(f"`{doc_id}`").alias("id"), label.alias("source"), body.alias("text"))
    taken = mix(narrow, weights, "id", keep=["id", "source"], **more)
    keys = ["no_id", "key_id", "no_source", "key_source", "size"]  # without nulls: window and join share one partitioning

    def keyed(i: Column, src: Column) -> list[Column]:
        return [i.isNull().alias("no_id"), F.coalesce(i.cast("string"), F.lit("")).alias("key_id"), src.isNull().alias("no_source"), F.coalesce(src.cast("string"), F.lit("")).alias("key_source")]

    taken = taken.select(*keyed(F.col("row.id"), F.col("row.source")), "size", "copies")
    taken = taken.groupBy(*keys).agg(F.min("copies").alias("least"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("extra"))
    rows = docs.select(F.struct("*").alias("row"), *keyed(F.col(f"`{doc_id}`"), label), word_count(body).alias("size"), F.xxhash64(body).alias("h"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h")))
    both = rows.join(taken, keys)
    copies = (F.col("least") + (F.col("r") <= F.col("extra")).cast("bigint")).cast("int")
    each = both.select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return each.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled quality 1 weighs 1, quality 0 a quarter."""
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.25).alias("weight"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_mixing": op7_mixing}
ORACLE_SQL = {
    "op7_mixing": rf"""
WITH q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE END) AS weight FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER win AS r, CAST(coalesce(sum(ss) OVER (win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s0,
  CAST(coalesce(sum(w) OVER (win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w0,
  CAST(sum(ss) OVER () AS BIGINT) AS st, CAST(sum(w) OVER () AS BIGINT) AS wt FROM s WINDOW win AS (ORDER BY ss / w, source NULLS LAST)),
v AS (SELECT *, (st - {MAX_EPOCHS} * s0) / (wt - w0) AS level FROM o),
c AS (SELECT min(r) AS cr, arg_min(level, r) AS lev FROM v WHERE level * w <= {MAX_EPOCHS} * ss),
t AS (SELECT source, ss, CASE WHEN r < cr THEN CAST({MAX_EPOCHS} * ss AS DOUBLE) ELSE lev * w END AS target FROM v, c),
k AS (SELECT d.doc_id, d.source, size, -ln((CAST('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {2**52}::DOUBLE) / coalesce(weight, {DEFAULT_WEIGHT}::DOUBLE) AS key
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM k),
e AS (SELECT p.*, ss, target, CASE WHEN ss > 0 THEN CAST(floor(target / ss) AS BIGINT) ELSE 0 END AS epochs FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, ss AS source_size, target,
  size * least({MAX_EPOCHS}, epochs + CASE WHEN 2 * upto - size <= 2 * (target - epochs * ss) THEN 1 ELSE 0 END) AS taken FROM e"""
}
