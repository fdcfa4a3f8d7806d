"""Row selection and schema alignment shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the smallest in ``order``.

    Written as an aggregate and not as a window: the minimum is taken on the map
    side first, so a key holding a third of the table never reaches one task whole.
    Remaining columns close the ordering, which makes the choice deterministic.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min(ranked).alias("_row"))
    return picked.select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fixed output, tolerant input: missing columns become typed nulls, extras go."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def union_aligned(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_present(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def require_columns(df: DataFrame, required: tuple[str, ...], label: str) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{label}: missing columns {missing}; received {sorted(df.columns)}")


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the position of each row, from 0, in the present order of ``df``.

    Positions inside a partition come from the row ids; what precedes a partition is a
    running sum over one row per partition. No task sees more than its own share.
    """
    placed = df.withColumn("_p", F.spark_partition_id()).withColumn(
        "_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)
    )
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return placed.join(before, "_p").withColumn(name, F.col("_before") + F.col("_i")).drop(
        "_p", "_i", "_before"
    )
