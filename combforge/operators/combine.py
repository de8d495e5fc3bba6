"""K-combination enumeration and the projection of a combination.

One ``explode`` per slot: a row carries the rest of its sequence, so no array of
C(n, K) combinations is ever held in memory, and the overlap rule prunes a
prefix before the next slot multiplies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combforge.config import require
from combforge.errors import EnumerationTooLargeError
from combforge.sources import CONVOLUTION


def motif_columns(k: int) -> list[str]:
    return [f"m{i}" for i in range(1, k + 1)]


def distance_columns(k: int) -> list[str]:
    return [f"d{i}{i + 1}" for i in range(1, k)]


def key_columns(k: int, case: str) -> list[str]:
    return motif_columns(k) + (distance_columns(k) if case == CONVOLUTION else [])


def combination_count(k: int, n: Column | str = "n") -> Column:
    """C(n, k) as DOUBLE."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (F.col(n) if isinstance(n, str) else n) - (out * F.lit(float(i)))
        out = out / F.lit(float(i + 1))
    return out


def predicted_combinations(sequences: DataFrame, k: int) -> DataFrame:
    n = F.size("features").cast("double")
    return sequences.agg(F.coalesce(F.sum(F.when(n >= k, combination_count(k, n)).otherwise(0.0)), F.lit(0.0)).alias("combinations"))


def guard(sequences: DataFrame, k: int, limit: int) -> None:
    """Fail early when the enumeration would exceed ``limit`` rows."""
    found = predicted_combinations(sequences, k).first()["combinations"]
    if found > limit:
        raise EnumerationTooLargeError(f"{found:.0f} combinations of size {k} exceed the limit of {limit}")


def enumerate_combinations(sequences: DataFrame, k: int, case: str, filter_len: int | None = None, overlap: str = "reject", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every ascending index K-subset of every sequence, projected.

    sequences: the result of ``normalise``; when its features carry no
    contribution, neither does the result. Returns m1..mK, for positional input
    also d12.., start, end, then data_index, contribution and ``carry``.
    Sequences shorter than k give no row.
    """
    require(k > 0, "motif_size must be positive")
    conv = case == CONVOLUTION
    require(not conv or filter_len is not None, "positional features need filter_len")
    weighted = "contribution" in sequences.schema["features"].dataType.elementType.fieldNames()
    fields = ["id", *(["pos"] if conv else []), *(["contribution"] if weighted else [])]
    df = sequences.filter(F.size("features") >= k).select("data_index", *carry, F.col("features").alias("rest"))
    for s in range(1, k + 1):
        done = [f"{f}_{j}" for j in range(1, s) for f in fields]
        df = df.select("data_index", *carry, *done, "rest", F.posexplode("rest").alias("at", "item"))
        df = df.filter(F.size("rest") - F.col("at") > k - s)
        if conv and s > 1 and overlap == "reject":
            df = df.filter(F.col("item")["pos"] - F.col(f"pos_{s - 1}") >= filter_len)
        rest = [] if s == k else [F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest")]
        df = df.select("data_index", *carry, *done, *(F.col("item")[f].alias(f"{f}_{s}") for f in fields), *rest)
    out = [F.col(f"id_{i}").alias(f"m{i}") for i in range(1, k + 1)]
    if conv:
        out += [(F.col(f"pos_{i + 1}") - F.col(f"pos_{i}") - filter_len).alias(f"d{i}{i + 1}") for i in range(1, k)]
        out += [F.col("pos_1").alias("start"), (F.col(f"pos_{k}") + (filter_len - 1)).alias("end")]
    out.append(F.col("data_index"))
    if weighted:
        total = F.lit(0).cast("float")
        for i in range(1, k + 1):  # FLOAT, left to right
            total = total + F.col(f"contribution_{i}")
        out.append(total.alias("contribution"))
    return df.select(*out, *carry)


def enumerate_by_join(sequences: DataFrame, k: int, case: str, filter_len: int | None = None, overlap: str = "reject", carry: tuple[str, ...] = ()) -> DataFrame:
    """The same rows by a left-deep self join on the index, for long sequences."""
    conv = case == CONVOLUTION
    long = sequences.select("data_index", *carry, F.posexplode("features").alias("at", "item"))
    df = None
    for s in range(1, k + 1):
        side = long.select("data_index", *(carry if s == 1 else ()), F.col("at").alias(f"at_{s}"), F.col("item").alias(f"item_{s}"))
        if df is None:
            df = side
            continue
        side = side.withColumnRenamed("data_index", "right_index")
        on = (F.col("data_index") == F.col("right_index")) & (F.col(f"at_{s - 1}") < F.col(f"at_{s}"))
        if conv and overlap == "reject":
            on = on & (F.col(f"item_{s}")["pos"] - F.col(f"item_{s - 1}")["pos"] >= filter_len)
        df = df.join(side, on).drop("right_index")
    packed = df.select("data_index", *carry, F.array(*(F.col(f"item_{i}") for i in range(1, k + 1))).alias("features"))
    return enumerate_combinations(packed, k, case, filter_len, "allow", carry)
