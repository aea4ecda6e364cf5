"""Row selection and joins that hold up on large and uneven tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Copies of a one-row-per-store table that a large table is joined to.
STORE_COPIES = 16


def join_stores(
    big: DataFrame, per_store: DataFrame, spread: list[str], how: str = "inner"
) -> DataFrame:
    """Join a large table to one row per store.

    A short store list is broadcast by its measured size. Beyond that the join key is
    the store and a hash of the `spread` columns, so that a store with much of the
    table is not one task's work; the adaptive skew join can split it further.
    """
    copy = F.pmod(F.xxhash64(*spread), F.lit(STORE_COPIES)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(STORE_COPIES - 1)))
    return (
        big.withColumn("_copy", copy)
        .join(per_store.withColumn("_copy", copies), ["store_id", "_copy"], how)
        .drop("_copy")
    )


def keep_computed(df: DataFrame, condition: Column) -> DataFrame:
    """`df.where(condition)` for a condition on columns that were costly to compute.

    A filter would be pushed below the projection and compute them a second time;
    inlining a one-row array is not pushed.
    """
    return df.select(F.inline(F.when(condition, F.array(F.struct(*df.columns)))))
