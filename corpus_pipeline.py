"""From raw documents to shards: five stages, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combforge.llm import decontaminate, language, mixing, sharding, similar
from combforge.llm.common import clash_free, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose best language is not
    more likely than all others together."""
    return language.accepted(docs, language.trained(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays.

    Near copies have a Jaccard similarity of 0.8 or more over their different
    five-word shingles: SimHash tiles propose, texts decide, and an exact join
    covers pairs whose fingerprints lie apart (``similar``). Rows with a null
    doc_id stay; repeated rows of a doc_id with the same text are reduced to one.

    Texts are shuffled once, by doc_id.
    """
    groups = similar.groups(docs, width=5, similarity=0.8)
    gone = groups.groupBy("doc_id").agg(F.min("component_id").alias("root"), F.count(F.lit(1)).alias("times"))
    marked = gone.filter("doc_id <> root OR times > 1").select(F.col("doc_id").alias("id"), (F.col("doc_id") != F.col("root")).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"))
    rows = rows.join(marked, "id", "left").filter("NOT coalesce(gone, false)")
    once = rows.filter("gone IS NULL").select("row.*")
    return once.unionByName(rows.filter("gone IS NOT NULL").select("row.*").dropDuplicates(["doc_id", "text"]))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, as it is or re-parameterised."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0 to 3 rows."""
    return mixing.repeated(docs, mixing.quality_weights(spark, sf_dir))


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot."""
    shard, slot = clash_free(docs.columns, "shard"), clash_free(docs.columns, "slot")
    return sharding.interleave(docs).select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", cut_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
