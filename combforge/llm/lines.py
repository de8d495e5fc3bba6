"""Line deduplication across documents (DataFrame functions only).

Lines are exploded with their position; a normalised key is hashed to 128 bits;
different documents are counted per hash with partial aggregation; the places to
drop come from a join that adaptive execution can split on a hot line; the text
is put together again by position. Only hashes and places are shuffled on the
way, whole texts once.

Null or empty text is one empty line. A null doc_id counts as no document and
keeps no line. Rows that repeat a doc_id are the same document; each gives one
output row. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combforge.llm.common import LOWER, SPACE, UPPER, ascii_lower, table


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Adds kept_text, n_lines, n_dropped (a clashing name of the input is replaced).

    Keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents stay in the largest doc_id only.
    """
    out = ["kept_text", "n_lines", "n_dropped"]
    keep = [c for c in docs.columns if c.lower() not in out]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ident = (F.col(f"`{doc_id}`").alias("d"), F.xxhash64(body).alias("th"))
    lines = docs.select(*ident, F.posexplode_outer(F.split(body, "\n")).alias("pos", "line"))
    lines = lines.select("d", "th", "pos", ascii_lower(F.btrim("line", F.lit(SPACE))).alias("key")).filter(F.length("key") >= min_chars)
    lines = lines.select("d", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    common = lines.groupBy("h1", "h2").agg(F.count_distinct("d").alias("n"), F.max("d").alias("keeper")).filter(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    gone = lines.join(common, ["h1", "h2"]).filter(F.col("d").isNull() | (F.col("d") != F.col("keeper")))
    gone = gone.groupBy("d", "th").agg(F.collect_set("pos").alias("gone")).withColumnsRenamed({"d": "gd", "th": "gth"})
    rows = docs.select(*ident, F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), body.alias("body"))
    rows = rows.join(gone, F.col("d").eqNullSafe(F.col("gd")) & (F.col("th") == F.col("gth")), "left")
    rows = rows.select("row", "gone", "body", F.split("body", "\n").alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    return rows.select("row.*", kept.alias("kept_text"), F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_SPACE_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
QUERIES = {"op5_lines": op5_lines}
ORACLE_SQL = {
    "op5_lines": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {_SPACE_SQL}), '{UPPER}', '{LOWER}') AS key FROM l),
common AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, pos, line, coalesce(k.doc_id <> keeper, false) AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
}
