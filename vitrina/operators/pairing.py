"""Consecutive snapshots of a store, matched by product.

Input everywhere is the `observations` table: one row per product listed in a
snapshot, with `snap_ord` numbering the store's snapshots 1, 2, 3 … and `pos`
giving the product's place in its snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.operators.ordering import rank_in_blocks

PRODUCT_KEY = ["store_id", "product_id"]
CELL_KEY = [*PRODUCT_KEY, "snap_ord"]
# More than any bigint position.
HISTORY_STRIDE = 10**19


def number_snapshots(snapshots: DataFrame) -> DataFrame:
    """Adds `snap_ord`: capture time order per store, file name breaking ties."""
    return rank_in_blocks(
        snapshots,
        ["store_id"],
        F.to_date("scraped_at"),
        [F.col("scraped_at"), F.col("source_file")],
        "snap_ord",
    ).withColumn("snap_ord", F.col("snap_ord").cast("int"))


def history_place() -> Column:
    """Place of a row in its store's history, snapshot first, as one sortable number.

    A number and not a struct, because Spark hash-aggregates numbers but sorts its
    input to aggregate structs.
    """
    stride = F.lit(str(HISTORY_STRIDE)).cast("decimal(20,0)")
    return F.col("snap_ord").cast("decimal(10,0)") * stride + F.col("pos")


def last_rows(observations: DataFrame, *columns: str) -> DataFrame:
    """One row per product and snapshot: the last one listed wins.

    `max_by` combines in the map tasks, so a product id repeated without end costs
    one row per task.
    """
    return observations.groupBy(*CELL_KEY).agg(
        *[F.max_by(name, "pos").alias(name) for name in columns]
    )


def matched_pairs(observations: DataFrame) -> DataFrame:
    """Every row joined to its product's last row in the snapshot just before.

    The snapshot number is part of the key: it breaks the match across a gap and
    spreads one product's history over many tasks. The earlier side is unique, and
    it is shuffled again after its aggregation, so the adaptive skew join can split
    the later side when one id fills a snapshot.
    """
    before = last_rows(observations, "price", "stock", "sold_qty").select(
        *PRODUCT_KEY,
        (F.col("snap_ord") + 1).alias("snap_ord"),
        F.col("price").alias("start_price"),
        F.col("stock").alias("start_stock"),
        F.col("sold_qty").alias("start_sold_qty"),
    )
    after = observations.select(*CELL_KEY, "pos", "stock", "sold_qty")
    return after.join(before, CELL_KEY)


def with_signals(pairs: DataFrame) -> DataFrame:
    """Counter movement and stock drop; null where either end is unknown."""
    counted = F.col("sold_qty") - F.col("start_sold_qty")
    return pairs.withColumns(
        {
            "sold_delta": F.when(counted.isNotNull(), F.greatest(counted, F.lit(0))),
            "stock_drop": F.col("start_stock") - F.col("stock"),
        }
    )


def with_units(signals: DataFrame) -> DataFrame:
    """Units sold by the larger known signal, units restocked, revenue at start price."""
    delta, drop = F.col("sold_delta"), F.col("stock_drop")
    drop_only = F.greatest(F.coalesce(drop, F.lit(0)), F.lit(0))
    sold = F.when(delta.isNotNull(), F.greatest(delta, drop_only)).otherwise(drop_only)
    unseen = delta - drop
    restocked = (
        F.when(unseen > 0, unseen).when(drop < 0, -drop).otherwise(F.lit(0))
    )
    return signals.withColumns({"sold": sold, "restocked": restocked}).withColumn(
        "revenue", F.col("sold") * F.coalesce(F.col("start_price"), F.lit(0))
    )


def pair_deltas(observations: DataFrame) -> DataFrame:
    """What happened to each product between consecutive snapshots of its store."""
    return with_units(with_signals(matched_pairs(observations)))
