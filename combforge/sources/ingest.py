"""Two interchangeable input layouts are accepted.

nested: ``data_index, features ARRAY<STRUCT<feature, contribution>>`` or
        ``data_index, features ARRAY<STRUCT<filter, contribution, position>>``
long:   one row per activation, ``data_index, feature, contribution`` or
        ``data_index, filter, contribution, position [, ordinal]``

Null ids, null sequence ids and id 0 (the padding sentinel) take no part.
A null contribution counts as 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from combforge.errors import EmptyInputError, SchemaError

ORDINARY = "OrdinaryFeatures"
CONVOLUTION = "Convolution"

_LAYOUTS = {frozenset(("feature", "contribution")): ORDINARY, frozenset(("filter", "contribution", "position")): CONVOLUTION}


def make_conv_feature(filter_id, contribution, position) -> Column:
    """A positional feature as a struct column."""
    return F.struct(F.lit(filter_id).cast("int").alias("filter"), F.lit(contribution).cast("float").alias("contribution"), F.lit(position).cast("int").alias("position"))


def infer_case(df: DataFrame) -> str:
    """Tell the feature layout from the field names."""
    if "data_index" not in df.columns:
        raise SchemaError("a data_index column is required")
    if "features" in df.columns:
        kind = df.schema["features"].dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
            raise SchemaError("features must be an array of structs")
        case = _LAYOUTS.get(frozenset(kind.elementType.fieldNames()))
    else:
        case = next((c for names, c in _LAYOUTS.items() if names <= set(df.columns)), None)
    if case is None:
        raise SchemaError("features need (feature, contribution) or (filter, contribution, position)")
    return case


def validate(df: DataFrame) -> str:
    """Infer the case and insist on at least one row."""
    case = infer_case(df)
    if df.isEmpty():
        raise EmptyInputError("the input holds no sequence")
    return case


def from_dict(spark: SparkSession, sequences: dict, case: str) -> DataFrame:
    """Sequences held in memory: id -> list of tuples in field order."""
    fields = "feature INT, contribution FLOAT" if case == ORDINARY else "filter INT, contribution FLOAT, position INT"
    return spark.createDataFrame([(int(k), list(v)) for k, v in sequences.items()], f"data_index BIGINT, features ARRAY<STRUCT<{fields.replace(' ', ': ').replace(',:', ',')}>>")


def nest(df: DataFrame, case: str | None = None) -> DataFrame:
    """Long layout to nested layout: one shuffle by data_index."""
    case = case or infer_case(df)
    if "features" in df.columns:
        return df.select(F.col("data_index").cast("bigint").alias("data_index"), "features")
    fields = _fields(case, F.col)
    if case == CONVOLUTION:
        ordinal = F.col("ordinal").cast("bigint") if "ordinal" in df.columns else F.lit(0).cast("bigint")
        item = F.struct(fields["position"].alias("position"), ordinal.alias("ordinal"), fields["filter"].alias("filter"), fields["contribution"].alias("contribution"))
    else:
        item = F.struct(*(c.alias(k) for k, c in fields.items()))
    keep = F.col("data_index").isNotNull() & fields[_id(case)].isNotNull() & (fields[_id(case)] != 0)
    return df.filter(keep).groupBy(F.col("data_index").cast("bigint").alias("data_index")).agg(F.sort_array(F.collect_list(item)).alias("features"))


def _id(case: str) -> str:
    return "feature" if case == ORDINARY else "filter"


def _fields(case: str, get) -> dict[str, Column]:
    contribution = F.coalesce(get("contribution").cast("float"), F.lit(0).cast("float"))
    if case == ORDINARY:
        return {"feature": get("feature").cast("int"), "contribution": contribution}
    return {"filter": get("filter").cast("int"), "contribution": contribution, "position": F.coalesce(get("position").cast("int"), F.lit(0))}


def normalise(df: DataFrame, case: str | None = None, contributions: bool = True) -> DataFrame:
    """``data_index, features ARRAY<STRUCT<id, pos, contribution>>`` in canonical order.

    Ordinary sequences are ordered by (id, contribution), positional ones by
    position with ties in input order. Sequences left empty are dropped.
    ``contributions=False`` leaves contribution out, for count-only plans.
    """
    case = case or infer_case(df)
    nested = nest(df, case)
    if case == ORDINARY:
        items = F.array_sort(F.transform("features", lambda x: F.struct(x["feature"].cast("int").alias("id"), F.coalesce(x["contribution"].cast("float"), F.lit(0).cast("float")).alias("contribution"))))
        items = F.transform(items, lambda x: F.struct(x["id"].alias("id"), F.lit(0).alias("pos"), *([x["contribution"].alias("contribution")] if contributions else [])))
    else:
        has_ordinal = "ordinal" in nested.schema["features"].dataType.elementType.fieldNames()
        items = F.array_sort(
            F.transform(
                "features",
                lambda x, i: F.struct(F.coalesce(x["position"].cast("int"), F.lit(0)).alias("pos"), (x["ordinal"] if has_ordinal else i).alias("ordinal"), x["filter"].cast("int").alias("id"), F.coalesce(x["contribution"].cast("float"), F.lit(0).cast("float")).alias("contribution")),
            )
        )
        items = F.transform(items, lambda x: F.struct(x["id"].alias("id"), x["pos"].alias("pos"), *([x["contribution"].alias("contribution")] if contributions else [])))
    items = F.filter(items, lambda x: x["id"].isNotNull() & (x["id"] != 0))
    return nested.filter(F.col("data_index").isNotNull()).select("data_index", items.alias("features")).filter(F.size("features") > 0)


def max_active_len(sequences: DataFrame) -> DataFrame:
    return sequences.agg(F.max(F.size("features")).alias("max_active_len"))


def length_stats(sequences: DataFrame) -> DataFrame:
    n = F.size("features")
    return sequences.agg(F.count(F.lit(1)).alias("n_sequences"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len"))


def merge_duplicates(df: DataFrame) -> DataFrame:
    """Long ordinary input with repeated features of a sequence summed."""
    return df.groupBy("data_index", "feature").agg(F.sum("contribution").alias("contribution"))
