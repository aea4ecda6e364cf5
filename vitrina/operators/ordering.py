"""Rankings inside a group that may be most of the table.

`first_n` is for top lists: the row-number filter lets Spark prune in the map
tasks, so only n rows per group and task are shuffled. `rank_in_blocks` and
`rank_within` number every row of a group without bringing the group together:
rows are ranked inside ordered blocks and shifted by the size of earlier blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.session import cut_lineage, stored_bytes, written_table

# A block holds about so many bytes of stored rows.
BLOCK_BYTES = 64 << 20


def first_n(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, into: str = "rank"
) -> DataFrame:
    """The first n rows of each group. `order` must tell all rows of a group apart.

    Spark prunes in the map tasks up to its row-number threshold; longer lists are
    numbered block by block instead.
    """
    prunable = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > prunable:
        return rank_within(df, group, order, into).where(F.col(into) <= n)
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(into, F.row_number().over(window)).where(F.col(into) <= n)


def rank_in_blocks(
    df: DataFrame,
    group: Sequence[str],
    block: Column,
    order: Sequence[Column],
    into: str = "rank",
) -> DataFrame:
    """Row number per group, where `block` never decreases along `order`."""
    keys = [*group, "_block"]
    blocked = df.withColumn("_block", block)
    earlier = (
        Window.partitionBy(*group)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        blocked.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = blocked.withColumn("_inside", F.row_number().over(inside))
    return (
        ranked.join(offsets, keys)
        .withColumn(into, F.col("_offset") + F.col("_inside"))
        .drop("_block", "_offset", "_inside")
    )


def rank_within(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    into: str = "rank",
    blocks: int | None = None,
) -> DataFrame:
    """Row number per group for any order. `order` must tell all rows of a group apart.

    The blocks are range partitions, so a large group spans many of them. Rows are written
    first: ranges are sampled from the table and not by making the rows twice, and its size
    gives the number of blocks, which keeps a block's size at any size of the table. The placed
    rows are checkpointed because both the counts and the rows must see the same blocks.
    """
    stored = written_table(df, "unranked")
    blocks = blocks or block_count(stored)
    placed = stored.repartitionByRange(blocks, *[F.col(c) for c in group], *order)
    placed = cut_lineage(placed.withColumn("_place", F.spark_partition_id()))
    return rank_in_blocks(placed, group, F.col("_place"), order, into).drop("_place")


def block_count(stored: DataFrame) -> int:
    """Blocks of a stored table: of bounded size, and as many as a shuffle has at least."""
    least = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(stored_bytes(stored) / BLOCK_BYTES))
