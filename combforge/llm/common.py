"""Expressions and helpers that several operators share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other code point as it is.

    ``lower`` does exactly that on pure ASCII, where octets equal code points.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def unit_hash(*parts: Column | str) -> Column:
    """52 bits of md5 as BIGINT; the same number in any engine."""
    joined = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("bigint")


def clash_free(names: list[str], wanted: str) -> str:
    """``wanted``, with underscores appended while it is taken."""
    lower = {n.lower() for n in names}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def shared_path(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    Without ``spark.checkpoint.dir`` a temporary folder serves, in local mode
    only; anywhere else executors would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="combforge-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


#: Delete a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict[int, list] = {}  # session: number of writes going on, setting before them


@contextlib.contextmanager
def _cleanup(spark: SparkSession):
    """CLEANUP is on while any ``written`` of the session runs; then as before."""
    key = id(spark)
    with _lock:
        held = _writing.setdefault(key, [0, spark.conf.get(CLEANUP)])
        held[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(CLEANUP, _writing.pop(key)[1])


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back.

    What was shuffled for the table is deleted at once; nothing reads it again.
    """
    spark, path = df.sparkSession, path or shared_path(df.sparkSession)
    with _cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT_KEYS = 1000


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join with ``facts``, which has one row per key.

    The facts of the ``HOT_KEYS`` keys of most ``weight`` are broadcast, at most
    that many rows, so the rows of a hot key stay where they are; the others meet
    by shuffle. Both inputs are read twice.
    """
    top = facts.orderBy(F.desc(weight), *keys).limit(HOT_KEYS)
    hot = rows.join(F.broadcast(top), keys)
    return hot.unionByName(rows.join(F.broadcast(top.select(*keys)), keys, "left_anti").join(facts, keys))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
